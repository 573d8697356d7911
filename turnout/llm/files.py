"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from turnout.session import shared_folder
from turnout.streaming.jobs import remove_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage as a checkpoint does, in a third of its space.

    The folder is noted in ``steps``, for ``discard``.
    """
    spark = df.sparkSession
    folder = run_folder(spark, "step")
    df.write.parquet(folder)
    if steps is not None:
        steps.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, steps: list[str]) -> None:
    """Removes the tables of steps that nothing reads any more."""
    for folder in steps:
        remove_folder(spark, folder)
    steps.clear()


def dealt(names: DataFrame, *keys: str, most: int = 10_000) -> DataFrame:
    """Rows that name files or parts of them, dealt out to about one task each, up to ``most`` tasks.

    The number is given, as the adaptive plan goes by the bytes of the rows and would join the names of large files into one task.
    """
    return names.repartition(min(2 * max(1, names.count()), most), *keys)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path there."""
    return pafs.FileSystem.from_uri(uri)


def attempt_file(folder: str, stem: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses.

    A task that is run again writes a new file.  Readers go by the manifest of the finished tasks, so what a lost attempt
    left behind is never read.
    """
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


class Output:
    """A file opened for writing in the shared folder, which is made if needed."""

    def __init__(self, uri: str):
        system, path = store(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.size, self.stream = uri, 0, system.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def save_arrays(folder: str, stem: str, **arrays: np.ndarray) -> str:
    """Writes named arrays as one file of the shared folder; returns its name."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    out = Output(attempt_file(folder, stem, ".npz"))
    out.write(held.getvalue())
    out.close()
    return out.uri


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file that ``save_arrays`` wrote."""
    system, path = store(uri)
    with system.open_input_file(path) as file, np.load(io.BytesIO(file.read())) as arrays:
        return {k: arrays[k] for k in arrays.files}


#: Arrow batches that reach Python hold whole texts; Spark's own limits (10,000 rows, 64 MB) would fill a small executor.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Prepares a session for tasks in Python: bounds their batches, and gives the executors this package (once), so
    that tasks can import it wherever the driver found it."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_turnout_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.writestr(str(file.relative_to(package.parent)), file.read_bytes())
    out = Output(f"{run_folder(spark, 'code')}/{package.name}.zip")
    out.write(held.getvalue())
    out.close()
    context.addPyFile(out.uri)
    context._turnout_shipped = True
