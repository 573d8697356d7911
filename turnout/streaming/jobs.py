"""Continuous forms of the batch operators.

Sinks write one folder per micro-batch (``batch_id=N``) and overwrite it on replay, so a restarted batch
leaves no second copy.  A ``BucketTable`` keeps the rows by key; for aggregates in update mode the table is the
latest row per key over the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from turnout.functions.dates import business_time, month_of, parse_retention
from turnout.functions.numbers import MONEY
from turnout.operators.changes import diff_changes
from turnout.operators.dedupe import keep_last
from turnout.operators.merge import append_idempotent, null_safe, upsert
from turnout.sources.files import spread
from turnout.sources.payloads import locate_records, located_records, map_registration_records

BATCH = "batch_id"


def write_batch(df: DataFrame, batch_id: int, folder: str) -> None:
    """Write a micro-batch to its own folder, replacing an earlier attempt."""
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def current_rows(batches: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """The table behind upsert batches: the last row per key; ``keep_if_null`` columns keep their last value."""
    keys = list(keys)
    body = [c for c in batches.columns if c not in (*keys, BATCH)]
    rest = [c for c in body if c not in keep_if_null]
    out = [F.max_by(F.struct(*rest), F.col(BATCH)).alias("_row")] if rest else []
    for c in keep_if_null:
        out.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(BATCH))).alias(c))
    picked = batches.groupBy(*keys).agg(*out)
    return picked.select(*keys, *[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in body])


def compact_batches(spark: SparkSession, folder: str, target: str, keys: Sequence[str],
                    keep_if_null: Sequence[str] = ()) -> None:
    """Fold all batches into one new folder, to be read in place of them."""
    write_batch(current_rows(read_batches(spark, folder), keys, keep_if_null), 0, target)


# --- keyed tables ------------------------------------------------------------------------


@dataclass(frozen=True)
class BucketTable:
    """A table of rows by key in hash buckets, changed by micro-batches.

    A batch reads the buckets its keys fall into and writes them anew, so its work follows the batch and not the
    table.  ``versions`` says, for every batch, which batch wrote each bucket last (one row a bucket).  A replayed
    batch starts from the versions of the batch before it, so it writes the same again.
    """

    folder: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        if batch_id < 0:
            return {}
        rows = spark.read.schema("bucket int, version long").parquet(f"{self.folder}/versions/{BATCH}={batch_id}").collect()
        return {r["bucket"]: r["version"] for r in rows}  # at most ``buckets`` rows

    def _read(self, spark: SparkSession, versions: Mapping[int, int], schema: StructType) -> DataFrame:
        paths = [f"{self.folder}/rows/{BATCH}={v}/bucket={b}" for b, v in versions.items()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def apply(self, incoming: DataFrame, batch_id: int, schema: StructType,
              change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Sets the rows of the touched buckets to ``change(before, incoming)``; gives the rows before."""
        spark = incoming.sparkSession
        known = self._versions(spark, batch_id - 1)
        touched = [r[0] for r in incoming.select(self._bucket()).distinct().collect()]  # at most ``buckets`` rows
        before = self._read(spark, {b: known[b] for b in touched if b in known}, schema)
        after = change(before, incoming).select(*[f.name for f in schema])
        out = after.withColumn("bucket", self._bucket())
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/{BATCH}={batch_id}")
        left = {r[0] for r in spark.read.parquet(f"{self.folder}/rows/{BATCH}={batch_id}").select("bucket").distinct().collect()}
        now = {b: v for b, v in known.items() if b not in touched} | {b: batch_id for b in touched if b in left}
        write_batch(spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1), batch_id, f"{self.folder}/versions")
        return before

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The table after the last batch."""
        last = spark.read.option("basePath", f"{self.folder}/versions").parquet(f"{self.folder}/versions").agg(F.max(BATCH)).first()[0]
        return self._read(spark, self._versions(spark, last), schema)

    def vacuum(self, spark: SparkSession) -> int:
        """Removes what the last two batches no longer refer to; gives the number of folders removed."""
        done = sorted(int(n.rpartition("=")[2]) for n in subfolders(spark, f"{self.folder}/versions"))
        live = {(b, v) for batch in done[-2:] for b, v in self._versions(spark, batch).items()}
        gone = [f"{self.folder}/versions/{BATCH}={n}" for n in done[:-2]]
        for batch in subfolders(spark, f"{self.folder}/rows"):
            version = int(batch.rpartition("=")[2])
            for bucket in subfolders(spark, f"{self.folder}/rows/{batch}"):
                if (int(bucket.rpartition("=")[2]), version) not in live and version < done[-1]:
                    gone.append(f"{self.folder}/rows/{batch}/{bucket}")
        for path in gone:
            remove_folder(spark, path)
        return len(gone)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders ``name=value`` directly below a path, on any file system Spark knows."""
    system, at = _file_system(spark, path)
    if not system.exists(at):
        return []
    return [f.getPath().getName() for f in system.listStatus(at) if f.isDirectory() and "=" in f.getPath().getName()]


def remove_folder(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


# --- activity log ------------------------------------------------------------------------


def append_activity(activity: DataFrame, ts: str, folder: str, checkpoint: str, files: int = 1) -> DataStreamWriter:
    """Append activity rows to a log partitioned by month, ``files`` files a month and micro-batch."""
    monthly = activity.withColumn("month", month_of(ts))
    dealt = monthly.repartition("month", F.pmod(F.xxhash64(ts), F.lit(files)))
    return (
        dealt.writeStream.format("parquet").partitionBy("month")
        .option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    )


def append_snapshot(snapshots: DataFrame, folder: str, key: str = "event_id") -> None:
    """Append snapshot rows to their table; earlier rows stay as they are."""
    snapshots.write.mode("append").partitionBy(key).parquet(folder)


def _cutoff_month(keep: str, as_of: datetime) -> Column:
    amount, unit = parse_retention(keep)
    moment = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return F.date_format(moment - F.expr(f"INTERVAL {amount} {unit}"), "yyyy-MM")


def retained(log: DataFrame, keep: str, as_of: datetime) -> DataFrame:
    """Rows of the months that are not wholly older than ``keep`` (such as ``12 months``).

    The condition is on the partition column, so old months are never read.
    """
    return log.where(F.col("month") >= _cutoff_month(keep, as_of))


def drop_old_months(spark: SparkSession, folder: str, keep: str, as_of: datetime) -> list[str]:
    """Removes the month folders that are wholly older than ``keep``; gives the months removed."""
    first = spark.range(1).select(_cutoff_month(keep, as_of)).first()[0]
    months = sorted(n.partition("=")[2] for n in subfolders(spark, folder) if n.startswith("month="))
    gone = [m for m in months if m < first]
    for month in gone:
        remove_folder(spark, f"{folder}/month={month}")
    return gone


# --- registration sync --------------------------------------------------------------------

#: Columns of a run log.
RUN = ("module string, trigger string, status string, started_at timestamp, finished_at timestamp, rows_read long, rows_rejected long, "
       "payloads_unknown long, rows_inserted long, rows_updated long, digest string, error string")


def sync_registrations(payloads: DataFrame, column: str, table: BucketTable, runs: str, checkpoint: str,
                       trigger: str = "schedule", keep_if_null: Sequence[str] = ()) -> DataStreamWriter:
    """Payload stream to registration upserts and a run log.

    Records are extracted once a micro-batch in tasks of bounded size, mapped, and the last one per e-mail is merged into ``table``.  Every run
    leaves a row in the log, also one that fails; a failed batch is then tried again by Spark.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = {"module": "registration_sync", "trigger": trigger, "started_at": datetime.now(timezone.utc).replace(tzinfo=None), "status": "failed"}
        located = locate_records(spread(batch, column), column).persist()
        try:
            rows, _ = map_registration_records(located_records(located, column))
            keyed = rows.withColumn("email_normalized", F.lower(F.trim("email")))
            position = [c for c in ("_file", "payload_no", "record_no") if c in keyed.columns]
            last = keep_last(keyed, ["email_normalized"], position).persist()
            before = table.apply(last, batch_id, last.schema, lambda old, new: upsert(
                old, new, ["email_normalized"], keep_if_null).drop("_action"))
            updated = before.join(last, "email_normalized", "left_semi").count()
            total = last.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("d")).first()
            seen = located.agg(F.coalesce(F.sum(F.greatest(F.size("records"), F.lit(0))), F.lit(0)).alias("read"), F.count_if("unknown").alias("unknown")).first()
            run |= {"status": "completed", "rows_read": seen["read"], "rows_rejected": seen["read"] - rows.count(), "payloads_unknown": seen["unknown"],
                    "rows_inserted": total["n"] - updated, "rows_updated": updated, "digest": f"{int(total['d'] or 0) % (1 << 64):016x}"}
            last.unpersist()
        except Exception as error:
            run["error"] = f"{type(error).__name__}: {error}"[:2000]
            raise
        finally:
            run["finished_at"] = datetime.now(timezone.utc).replace(tzinfo=None)
            names = [c.split()[0] for c in RUN.split(", ")]
            write_batch(spark.createDataFrame([tuple(run.get(n) for n in names)], RUN).coalesce(1), batch_id, runs)
            located.unpersist()

    return payloads.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last row of a run log."""
    rest = [c for c in runs.columns if c != BATCH]
    return runs.groupBy("module").agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("_r")).select("_r.*")


# --- ledger --------------------------------------------------------------------------------


def first_grants(ledger: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Ledger stream without repeats of an idempotency key that arrive within ``lateness``: bounded state, but a key
    that comes again after it passes.  ``grants_once`` never lets one pass."""
    return ledger.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["idempotency_key"])


def grants_once(ledger: DataFrame, order: Sequence[str], used: BucketTable, folder: str, checkpoint: str) -> DataStreamWriter:
    """Ledger stream to the rows to append: of each idempotency key only the first ever, whenever it comes again."""
    schema = StructType([ledger.schema["idempotency_key"]])

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.where("idempotency_key IS NOT NULL")
        before = used.apply(keyed.select("idempotency_key"), batch_id, schema, lambda old, new: old.unionByName(new).distinct())
        write_batch(append_idempotent(before, batch, "idempotency_key", order), batch_id, folder)

    return ledger.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def running_balances(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Balance per key over the stream so far (update mode)."""
    return ledger.groupBy(*keys).agg(F.sum(F.col("delta").cast(MONEY)).alias("balance"))


def write_updates(aggregate: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Write the rows each micro-batch changed; read them back with :func:`current_rows`."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, folder)

    return aggregate.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def keep_current(aggregate: DataFrame, table: BucketTable, checkpoint: str, vacuum_every: int = 20) -> DataStreamWriter:
    """Fold the rows each micro-batch changed into a keyed table, which is compacted in place.

    A batch rewrites the buckets of its keys, and every ``vacuum_every`` batches what no reader needs any more is removed, so the files that
    ``table.rows`` reads are one a bucket however many batches there were.  A replayed batch writes the same again.
    """
    schema, keys = aggregate.schema, list(table.keys)

    def newer(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
        return old.join(named, null_safe(keys, [f"_t_{k}" for k in keys]), "left_anti").unionByName(new)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        table.apply(changed, batch_id, schema, newer)
        changed.unpersist()
        if batch_id % vacuum_every == vacuum_every - 1:
            table.vacuum(batch.sparkSession)

    return aggregate.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)


# --- counts over time ------------------------------------------------------------------------


def windowed_counts(registrations: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """Registrations per business-time window; rows later than ``lateness`` are dropped."""
    local = registrations.select(business_time(ts).cast("timestamp").alias("_at"))
    return (
        local.withWatermark("_at", lateness).groupBy(F.window("_at", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "n")
    )


# --- change capture ----------------------------------------------------------------------------


def capture_changes(upserts: DataFrame, keys: Sequence[str], order: Sequence[Column | str], state: str, log: str,
                    checkpoint: str, deleted: str | None = None, buckets: int = 64) -> DataStreamWriter:
    """Stream of full rows to a change log: each micro-batch is compared with the rows of its keys before it.

    Rows whose ``deleted`` column is true remove their key.
    """
    table = BucketTable(state, tuple(keys), buckets)
    keys = list(keys)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        incoming = keep_last(batch, keys, order).persist()
        live = incoming if deleted is None else incoming.where(~F.coalesce(F.col(deleted), F.lit(False)))
        named = incoming.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
        match = null_safe(keys, [f"_t_{k}" for k in keys])
        before = table.apply(incoming, batch_id, incoming.schema, lambda old, new: old.join(named, match, "left_anti").unionByName(live))
        write_batch(diff_changes(before.join(named, match, "left_semi"), live, keys, [deleted] if deleted else []), batch_id, log)
        incoming.unpersist()

    return upserts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


__all__ = [
    "BucketTable", "append_activity", "append_snapshot", "capture_changes", "compact_batches", "current_rows", "drop_old_months",
    "first_grants", "grants_once", "keep_current", "latest_run", "read_batches", "retained", "running_balances", "subfolders",
    "sync_registrations", "windowed_counts", "write_batch", "write_updates",
]
