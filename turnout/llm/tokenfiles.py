"""Token counts from flat token files.

A flat file is nothing but little-endian 16- or 32-bit ids, each document followed by an end-of-document id.  There is no index: blocks
of a file are read independently and searched for the end-of-document id; what a block cannot know, the documents and the
last separator before it, comes from a prefix scan over the blocks' summaries.

Defined cases: a null or empty text is a document of no ids; ids after the last separator are a last document with
``terminated`` false; an empty file has no document; an empty table writes no file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnout.llm import wordbpe
from turnout.llm.files import Output, attempt_file, dealt, run_folder, ship, store

#: Ids in one block, and blocks in one group of the prefix scan.
BLOCK_IDS = 1 << 20
GROUP_BLOCKS = 4096


def id_width(tokenizer: str) -> int:
    """Bytes of an id in a file: 2 if the vocabulary allows, else 4."""
    return 2 if len(wordbpe.load(tokenizer).tokens) <= 1 << 16 else 4


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_bytes: int = 1 << 28) -> DataFrame:
    """Writes the texts' ids as flat files in the shared folder; gives (doc_id, file, ordinal, file_ids) in the order written.

    Special tokens in a text are ordinary text here, so the end-of-document id stands for nothing else.  The rows are the
    manifest: they are written once, and a file that they do not name (of a lost attempt) is not read.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "tokens")
    source = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"))
    width = id_width(tokenizer)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(tokenizer)
        out, ordinal = None, 0
        for batch in batches:
            for first, last, texts in wordbpe.text_blocks(batch.column(0)):
                ids, counts = bpe.encode_block(texts, special=False)
                if out is None or out.size >= file_bytes:
                    if out is not None:
                        out.close()
                    out, ordinal = Output(attempt_file(f"{folder}/data", "part", ".ids")), 0
                # Each document's ids move right by the number of separators before them.
                ends = np.cumsum(counts + 1)
                flat = np.full(int(ends[-1]), end_id, f"<u{width}")
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                out.write(flat.tobytes())
                n = last - first
                yield pa.record_batch([batch.column(1).slice(first, n), pa.array([out.uri] * n), pa.array(range(ordinal, ordinal + n), pa.int64()),
                                       pa.array((out.size // width - len(flat) + ends).tolist(), pa.int64())], names=["doc_id", "file", "ordinal", "file_ids"])
                ordinal += n
        if out is not None:
            out.close()

    ship(spark)
    source.mapInArrow(write, "doc_id bigint, file string, ordinal bigint, file_ids bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def file_blocks(files: DataFrame, width: int = 4, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, start, n) of every block of ``files`` (file, file_ids), dealt out evenly."""
    blocks = files.where(F.col("file_ids") > 0).select("file", "file_ids", F.posexplode(
        F.sequence(F.lit(0).cast("bigint"), F.col("file_ids") - 1, F.lit(block_ids).cast("bigint"))).alias("block", "start"))
    n = F.least(F.lit(block_ids).cast("bigint"), F.col("file_ids") - F.col("start"))
    return blocks.select("file", F.col("block").cast("bigint").alias("block"), "start", n.alias("n"))


def separators(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """One row a block: its separators' count, first and last place, and every document that ends in it but the first.

    ``inner`` holds the lengths of the documents that lie wholly in the block after its first separator.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = store(row["file"])
                with system.open_input_file(path) as file:
                    file.seek(row["start"] * width)
                    ids = np.frombuffer(file.read(row["n"] * width), kind)
                if len(ids) != row["n"]:
                    raise OSError(f"{row['file']} ends early")
                at = np.flatnonzero(ids == end_id)
                some = len(at) > 0
                yield pa.record_batch([
                    pa.array([row["file"]]), *(pa.array([row[c]], pa.int64()) for c in ("block", "start", "n")), pa.array([len(at)], pa.int64()),
                    *(pa.array([row["start"] + int(at[k]) if some else None], pa.int64()) for k in (0, -1)),
                    pa.array([np.diff(at) - 1], pa.list_(pa.int64()))], names=["file", "block", "start", "n", "found", "first", "last", "inner"])

    schema = "file string, block bigint, start bigint, n bigint, found bigint, first bigint, last bigint, inner array<bigint>"
    ship(blocks.sparkSession)
    return dealt(blocks, "file", "block").mapInArrow(scan, schema)


def stitch(found: DataFrame, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Adds ``docs_before`` and ``last_before`` (place of the last separator before the block, else -1).

    The scan has two levels, so no task holds more than a group of blocks, or the groups of a file.
    """
    grouped = found.withColumn("group", F.expr(f"block div {group_blocks}"))
    groups = grouped.groupBy("file", "group").agg(F.sum("found").alias("g_found"), F.max("last").alias("g_last"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.sum("g_found").over(before).alias("g_docs"), F.max("g_last").over(before).alias("g_before"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.withColumns({"b_docs": F.sum("found").over(inside), "b_before": F.max("last").over(inside)})
    zero = F.lit(0).cast("bigint")
    return local.join(groups, ["file", "group"]).withColumns({
        "docs_before": F.coalesce("g_docs", zero) + F.coalesce("b_docs", zero),
        "last_before": F.coalesce("b_before", "g_before", F.lit(-1).cast("bigint")),
    }).drop("group", "g_docs", "g_before", "b_docs", "b_before")


def count_tokens(files: DataFrame, end_id: int, width: int = 4, block_ids: int = BLOCK_IDS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(file, ordinal, n_tokens, terminated) of every document in ``files`` (file, file_ids)."""
    stitched = stitch(separators(file_blocks(files, width, block_ids), end_id, width), group_blocks)
    lengths = F.concat(F.array(F.col("first") - F.col("last_before") - 1), F.col("inner"))
    ended = stitched.where("found > 0").select("file", "docs_before", F.posexplode(lengths).alias("k", "n_tokens"))
    ended = ended.select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    ends = stitched.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("size"), F.sum("found").alias("ordinal"), F.max("last").alias("last"))
    rest = ends.withColumn("n_tokens", F.col("size") - 1 - F.coalesce("last", F.lit(-1).cast("bigint"))).where("n_tokens > 0")
    return ended.unionByName(rest.select("file", "ordinal", "n_tokens", F.lit(False).alias("terminated")))


def listed_files(spark: SparkSession, folder: str, suffix: str = ".ids", width: int = 4) -> DataFrame:
    """(file, file_ids) of the token files in a folder, by Spark's own listing."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select(F.col("path").alias("file"), F.expr(f"length div {width}").alias("file_ids"))


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """(doc_id, n_tokens) of every document, counted from the files written for it."""
    manifest = write_token_files(docs, tokenizer, end_id, doc_id, text)
    files = manifest.groupBy("file").agg(F.max("file_ids").alias("file_ids"))
    counted = count_tokens(files, end_id, id_width(tokenizer), **sizes)
    return manifest.hint("merge").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
