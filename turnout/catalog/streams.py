"""Streaming jobs run to the end of the available input."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from turnout.catalog import base
from turnout.catalog.base import query
from turnout.catalog.ingest import payloads, scratch
from turnout.session import pinned
from turnout.streaming.jobs import (
    BucketTable,
    append_activity,
    capture_changes,
    current_rows,
    drop_old_months,
    grants_once,
    keep_current,
    read_batches,
    running_balances,
    subfolders,
    sync_registrations,
    windowed_counts,
    write_updates,
)

#: Micro-batches a streamed table is split into.
BATCHES = 4


def finish(writer: DataStreamWriter) -> None:
    """Process everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def _batches(spark: SparkSession, rows: DataFrame, out: str, deal: Column | None = None, batches: int = BATCHES) -> Iterator[DataFrame]:
    """The rows as a stream, once for each micro-batch, which is written before; a query that goes on from its checkpoint takes just that.

    Rows are dealt by ``deal``, or by a hash so that keys come again in later ones.  A micro-batch is as many files as there were tasks to write it.
    """
    dealt = pinned(rows.withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.lit(batches)) if deal is None else deal))
    for n in range(batches):
        dealt.where(F.col("_deal") == n).drop("_deal").write.mode("append").parquet(f"{out}/in")
        yield spark.readStream.schema(rows.schema).parquet(f"{out}/in")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


@query("""SELECT user_id AS participant_id, event_type AS challenge_id,
  CAST(sum(CAST(value AS DECIMAL(14,4))) AS DOUBLE) AS balance FROM events GROUP BY 1, 2""")
def stream_balances(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark)
    keys = ["participant_id", "challenge_id"]
    table = BucketTable(f"{out}/table", tuple(keys), 16)
    for rows in _batches(spark, _events(spark, folder), out):
        ledger = rows.select(F.col("user_id").alias("participant_id"), F.col("event_type").alias("challenge_id"), F.col("value").alias("delta"))
        balances = running_balances(ledger, keys)
        finish(keep_current(balances, table, f"{out}/state"))
    return table.rows(spark, balances.schema).withColumn("balance", F.col("balance").cast("double"))


@query("""SELECT strftime(date_trunc('hour', ts + INTERVAL 330 MINUTE), '%Y-%m-%d %H') AS start, count(*) AS n
  FROM events GROUP BY 1""")
def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark)
    for rows in _batches(spark, _events(spark, folder), out):
        finish(write_updates(windowed_counts(rows, "ts", "1 hour", "400 days"), f"{out}/rows", f"{out}/state"))
    rows = current_rows(read_batches(spark, f"{out}/rows"), ["start"])
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("""SELECT DISTINCT user_id || '-' || event_type AS idempotency_key FROM events""")
def stream_first_grants(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that come in every batch pass once, however long after the first time they come again."""
    out = scratch(spark)
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    for rows in _batches(spark, _events(spark, folder), out):
        ledger = rows.select("event_id", key.alias("idempotency_key"))
        finish(grants_once(ledger, ["event_id"], BucketTable(f"{out}/used", ("idempotency_key",), 16), f"{out}/rows", f"{out}/state"))
    return read_batches(spark, f"{out}/rows").select("idempotency_key")


@query("""SELECT strftime(ts, '%Y-%m') AS month, event_type AS action, count(*) AS n FROM events
  WHERE strftime(ts, '%Y-%m') >= (SELECT strftime(max(ts) - INTERVAL 20 DAY, '%Y-%m') FROM events) GROUP BY 1, 2""")
def stream_activity_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log partitioned by month; the months before the last twenty days are removed, then the rest is read."""
    out = scratch(spark)
    for rows in _batches(spark, _events(spark, folder), out):
        finish(append_activity(rows, "ts", f"{out}/log", f"{out}/state"))
    last = _events(spark, folder).agg(F.max("ts")).first()[0]
    drop_old_months(spark, f"{out}/log", "20d", last)
    months = [f"{out}/log/{m}" for m in subfolders(spark, f"{out}/log")]
    log = spark.read.option("basePath", f"{out}/log").parquet(*months)
    return log.groupBy(F.col("month").cast("string").substr(1, 7).alias("month"), F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lower('user' || user_id || '@example.org') AS email_normalized,
    first(event_type ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END DESC) AS full_name
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1""")
def stream_registration_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Payload files streamed through extraction, mapping and upsert, a kind of event a micro-batch; the table's names after the last.

    The kind that came last is a registrant's name, whatever the numbers of its payloads are.
    """
    out = scratch(spark)
    kind = F.when(F.col("payload").startswith("["), 0).when(F.col("payload").startswith('{"ok"'), 1).when(F.col("payload").startswith('{"event"'), 2).otherwise(3)
    table = BucketTable(f"{out}/table", ("email_normalized",), 16)
    for source in _batches(spark, payloads(spark, folder), out, kind):
        finish(sync_registrations(source, "payload", table, f"{out}/runs", f"{out}/state"))
    return table.rows(spark, StructType.fromDDL("email_normalized string, full_name string"))


@query("""SELECT lower('user' || user_id || '@example.org') AS email_normalized,
    first(event_type ORDER BY event_id DESC) AS full_name FROM events
  WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1""")
def stream_registration_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The table after the sync, its payloads streamed in their order: the last name of every registrant."""
    out = scratch(spark)
    first, last = base.read_table(spark, folder, "events", ["event_id"]).agg(F.min("event_id"), F.max("event_id")).first()
    deal = F.expr(f"(payload_no - {first or 0}) * {BATCHES} div {(last or 0) - (first or 0) + 1}")
    table = BucketTable(f"{out}/table", ("email_normalized",), 16)
    for source in _batches(spark, payloads(spark, folder), out, deal):
        finish(sync_registrations(source, "payload", table, f"{out}/runs", f"{out}/state"))
    return table.rows(spark, StructType.fromDDL("email_normalized string, full_name string"))


@query("""SELECT 'completed' AS status, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) * 2
    + count(*) FILTER (event_type = 'signup') AS rows_read,
    count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS rows_rejected,
    count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup')) AS payloads_unknown,
    count(DISTINCT user_id) FILTER (event_type IN ('view', 'click', 'purchase', 'signup')) AS rows_inserted FROM events""")
def stream_run_log(spark: SparkSession, folder: str) -> DataFrame:
    """The run rows of a sync, added up."""
    out = scratch(spark)
    table = BucketTable(f"{out}/table", ("email_normalized",), 16)
    for source in _batches(spark, payloads(spark, folder), out):
        finish(sync_registrations(source, "payload", table, f"{out}/runs", f"{out}/state"))
    names = ("rows_read", "rows_rejected", "payloads_unknown", "rows_inserted")
    return read_batches(spark, f"{out}/runs").groupBy("status").agg(*(F.sum(n).alias(n) for n in names))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Three versions of every customer, the second unlike the first, the third a deletion for every fifth."""
    rows = base.read_table(spark, folder, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return rows.select("c_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v"), "c_name", "c_mktsegment").select(
        "c_custkey", "v", "c_name", F.when(F.col("v") == 1, F.col("c_mktsegment")).otherwise("MOVED").alias("segment"),
        ((F.col("v") == 3) & (F.col("c_custkey") % 5 == 0)).alias("gone"))


@query("""SELECT 'INSERT' AS op, count(*) AS n FROM customer UNION ALL
  SELECT 'UPDATE', count(*) FROM customer WHERE c_mktsegment IS DISTINCT FROM 'MOVED' UNION ALL
  SELECT 'DELETE', count(*) FROM customer WHERE c_custkey % 5 = 0""")
def stream_change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Inserts, then updates, then deletions and rows that did not change, a micro-batch each."""
    out = scratch(spark)
    for stream in _batches(spark, _versions(spark, folder), out, F.col("v") - 1, 3):
        finish(capture_changes(stream.drop("v"), ["c_custkey"], ["c_name"], f"{out}/rows", f"{out}/log", f"{out}/state", deleted="gone", buckets=16))
    return read_batches(spark, f"{out}/log").groupBy("op").agg(F.count(F.lit(1)).alias("n"))
