from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnout.streaming import jobs


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def put(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


LEDGER = "participant_id int, delta double, idempotency_key string, at timestamp"


def test_running_balances_over_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def again(data):
        put(spark, source, data, LEDGER)
        ledger = spark.readStream.schema(LEDGER).parquet(str(source))
        run(jobs.write_updates(jobs.running_balances(ledger, ["participant_id"]), out, str(tmp_path / "cp")))
        rows = jobs.current_rows(jobs.read_batches(spark, out), ["participant_id"])
        return {r.participant_id: float(r.balance) for r in rows.collect()}

    now = datetime(2026, 1, 1)
    assert again([(1, 2.0, "a", now), (2, 1.0, "b", now)]) == {1: 2.0, 2: 1.0}
    assert again([(1, 3.0, "c", now)]) == {1: 5.0, 2: 1.0}


def test_repeated_keys_are_dropped_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for data in ([(1, 2.0, "a", datetime(2026, 1, 1)), (1, 2.0, "a", datetime(2026, 1, 1))],
                 [(1, 2.0, "a", datetime(2026, 1, 1, 0, 5)), (1, 2.0, "b", datetime(2026, 1, 1))]):
        put(spark, source, data, LEDGER)
        ledger = spark.readStream.schema(LEDGER).parquet(str(source))
        run(jobs.first_grants(ledger, "at", "1 hour").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted(r.idempotency_key for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_change_capture_over_batches(spark, tmp_path):
    schema = "id int, name string, v int"
    source, state, log = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "log")
    for data in ([(1, "a", 1), (2, "b", 1)], [(1, "a", 2), (2, "b", 2), (1, "z", 3), (3, "c", 1)]):
        put(spark, source, data, schema)
        stream = spark.readStream.schema(schema).parquet(str(source))
        run(jobs.capture_changes(stream, ["id"], ["v"], state, log, str(tmp_path / "cp")))
    changes = {(r.batch_id, r.record_pk, r.op) for r in jobs.read_batches(spark, log).collect()}
    assert changes == {(0, '{"id":1}', "INSERT"), (0, '{"id":2}', "INSERT"), (1, '{"id":1}', "UPDATE"), (1, '{"id":2}', "UPDATE"),
                       (1, '{"id":3}', "INSERT")}


def test_changes_with_deletions_and_untouched_buckets(spark, tmp_path):
    schema = "id int, name string, gone boolean"
    source, state, log = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "log")
    steps = ([(i, "a", False) for i in range(40)], [(1, "b", False), (2, "a", False), (3, None, True), (99, None, True)], [(3, "c", False), (1, "b", False)])
    for data in steps:
        put(spark, source, data, schema)
        stream = spark.readStream.schema(schema).parquet(str(source))
        run(jobs.capture_changes(stream, ["id"], ["name"], state, log, str(tmp_path / "cp"), deleted="gone", buckets=8))
    changes = {(r.batch_id, r.record_pk, r.op) for r in jobs.read_batches(spark, log).where("batch_id > 0").collect()}
    assert changes == {(1, '{"id":1}', "UPDATE"), (1, '{"id":3}', "DELETE"), (2, '{"id":3}', "INSERT")}
    table = jobs.BucketTable(state, ("id",), 8)
    shape = spark.createDataFrame([], schema).schema
    rows = {r.id: r.name for r in table.rows(spark, shape).collect()}
    assert rows == {i: "a" for i in range(40)} | {1: "b", 3: "c"}
    assert len(jobs.subfolders(spark, f"{state}/rows/batch_id=2")) <= 2  # only the buckets that the batch touched
    assert table.vacuum(spark) > 0 and {r.id: r.name for r in table.rows(spark, shape).collect()} == rows


def test_a_key_never_passes_twice(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for year in (2020, 2026):
        put(spark, source, [(1, 2.0, "a", datetime(year, 1, 1)), (2, 1.0, None, datetime(year, 1, 1)), (3, 2.0, f"k{year}", datetime(year, 1, 1))], LEDGER)
        ledger = spark.readStream.schema(LEDGER).parquet(str(source))
        run(jobs.grants_once(ledger, ["participant_id"], jobs.BucketTable(str(tmp_path / "used"), ("idempotency_key",), 4), out, str(tmp_path / "cp")))
    assert sorted(str(r.idempotency_key) for r in jobs.read_batches(spark, out).collect()) == ["None", "None", "a", "k2020", "k2026"]


def test_a_failed_run_is_logged(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, json.dumps([{"email": "a@x.co"}]))], "payload_no int, payload string")
    stream = spark.readStream.schema("payload_no int, payload string").parquet(str(tmp_path / "in"))
    (tmp_path / "table").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        run(jobs.sync_registrations(stream, "payload", jobs.BucketTable(str(tmp_path / "table"), ("email_normalized",)), str(tmp_path / "runs"), str(tmp_path / "cp")))
    row = jobs.read_batches(spark, str(tmp_path / "runs")).first()
    assert row.status == "failed" and row.error and row.rows_inserted is None and row.finished_at >= row.started_at


def test_old_months_are_removed(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(m, f"2025-{m:02d}") for m in (1, 5, 6, 7)], "v int, month string").write.partitionBy("month").parquet(log)
    assert jobs.drop_old_months(spark, log, "2 months", datetime(2025, 7, 15)) == ["2025-01"]
    assert sorted(r.v for r in spark.read.parquet(log).collect()) == [5, 6, 7]
    jobs.append_snapshot(spark.createDataFrame([(1, "s")], "event_id int, scope_key string"), str(tmp_path / "snaps"))
    jobs.append_snapshot(spark.createDataFrame([(1, "s")], "event_id int, scope_key string"), str(tmp_path / "snaps"))
    assert spark.read.parquet(str(tmp_path / "snaps")).count() == 2


def test_registration_sync_and_run_log(spark, tmp_path):
    schema = "payload_no int, payload string"
    source, rows, runs = tmp_path / "in", jobs.BucketTable(str(tmp_path / "rows"), ("email_normalized",), 4), str(tmp_path / "runs")
    first = {"data": [{"email": "A@x.co", "name": "one", "city": "Pune"}, {"email": "a@X.co", "name": "two"}, {"name": "nobody"}]}
    for data in ([(1, json.dumps(first)), (2, json.dumps({"note": 1}))], [(3, json.dumps([{"email": "a@x.co", "full_name": "three"}]))]):
        put(spark, source, data, schema)
        stream = spark.readStream.schema(schema).parquet(str(source))
        run(jobs.sync_registrations(stream, "payload", rows, runs, str(tmp_path / "cp")))
    log = jobs.read_batches(spark, runs)
    assert tuple(log.where("batch_id = 0").select("rows_read", "rows_rejected", "payloads_unknown", "rows_inserted", "rows_updated").first()) == (3, 1, 1, 1, 0)
    last = jobs.latest_run(log).first()
    assert (last.status, last.trigger, last.rows_inserted, last.rows_updated, len(last.digest)) == ("completed", "schedule", 0, 1, 16)
    current = rows.rows(spark, spark.createDataFrame([], "email_normalized string, full_name string").schema)
    assert [(r.email_normalized, r.full_name) for r in current.collect()] == [("a@x.co", "three")]


def test_sync_queries_show_lost_updates(spark, tmp_path, monkeypatch):
    """A sync whose table keeps the first row of every e-mail gives other results than a right one."""
    from turnout.catalog import streams

    rows = [(i, 1 + i // 8, ["view", "click", "purchase", "signup"][i % 4]) for i in range(16)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "user_id", "event_type", "1.0D AS value", "'' AS props").write.parquet(str(tmp_path / "events.parquet"))
    both = lambda: ({tuple(r) for r in streams.stream_registration_sync(spark, str(tmp_path)).collect()},
                    {tuple(r) for r in streams.stream_registration_rows(spark, str(tmp_path)).collect()})
    assert both() == ({("user1@example.org", "signup"), ("user2@example.org", "signup")},) * 2
    monkeypatch.setattr(jobs, "upsert", lambda old, new, *a, **k: old.unionByName(new).dropDuplicates(["email_normalized"]).withColumn("_action", F.lit("")))
    kinds, names = both()
    assert kinds != {("user1@example.org", "signup"), ("user2@example.org", "signup")}


def test_the_last_payload_wins_within_a_batch(spark, tmp_path):
    schema = "payload_no int, payload string"
    table = jobs.BucketTable(str(tmp_path / "rows"), ("email_normalized",), 4)
    older = json.dumps([{"email": "b@x.co", "name": "b"}, {"email": "a@x.co", "name": "older"}])
    put(spark, tmp_path / "in", [(1, older), (2, json.dumps([{"email": "a@x.co", "name": "newer"}]))], schema)
    run(jobs.sync_registrations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "payload", table, str(tmp_path / "runs"), str(tmp_path / "cp")))
    current = table.rows(spark, spark.createDataFrame([], "email_normalized string, full_name string").schema)
    assert {tuple(r) for r in current.collect()} == {("a@x.co", "newer"), ("b@x.co", "b")}


def test_keep_if_null_survives_batches_and_compaction(spark, tmp_path):
    folder, target = str(tmp_path / "rows"), str(tmp_path / "compact")
    jobs.write_batch(spark.createDataFrame([("k", "name", 1)], "k string, n string, v int"), 0, folder)
    jobs.write_batch(spark.createDataFrame([("k", None, 2)], "k string, n string, v int"), 1, folder)
    jobs.write_batch(spark.createDataFrame([("k", None, 2)], "k string, n string, v int"), 1, folder)  # a replay
    jobs.compact_batches(spark, folder, target, ["k"], ["n"])
    assert [tuple(r) for r in jobs.read_batches(spark, target).select("k", "n", "v").collect()] == [("k", "name", 2)]


def test_activity_log_retention_prunes_months(spark, tmp_path):
    schema = "at timestamp_ntz, action string"
    source, log = tmp_path / "in", str(tmp_path / "log")
    put(spark, source, [(datetime(2025, m, 1), "VIEW") for m in (1, 5, 6)], schema)
    run(jobs.append_activity(spark.readStream.schema(schema).parquet(str(source)), "at", log, str(tmp_path / "cp")))
    kept = jobs.retained(spark.read.schema(schema + ", month string").parquet(log), "2 months", datetime(2025, 7, 15))
    assert sorted(r.at.month for r in kept.collect()) == [5, 6]
    assert "PartitionFilters: [isnotnull(month" in kept._jdf.queryExecution().executedPlan().toString()


def test_windowed_counts_use_business_time(spark, tmp_path):
    schema = "at timestamp_ntz"
    put(spark, tmp_path / "in", [(datetime(2026, 1, 1, 18, 29),), (datetime(2026, 1, 1, 18, 30),)], schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run(jobs.write_updates(jobs.windowed_counts(stream, "at", "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = jobs.current_rows(jobs.read_batches(spark, str(tmp_path / "out")), ["start"])
    days = {r[0]: r.n for r in got.select(F.date_format("start", "yyyy-MM-dd"), "n").collect()}
    assert days == {"2026-01-01": 1, "2026-01-02": 1}


def test_balances_stay_in_a_bounded_number_of_files(spark, tmp_path):
    schema = "participant_id int, delta double"
    table = jobs.BucketTable(str(tmp_path / "table"), ("participant_id",), 4)
    for turn in range(2):
        for n in range(5):
            put(spark, tmp_path / "in", [(k, 1.0) for k in range(20)] + [(None, 2.0), (100 + 5 * turn + n, 1.0)], schema)
        ledger = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        balances = jobs.running_balances(ledger, ["participant_id"])
        run(jobs.keep_current(balances, table, str(tmp_path / "cp"), vacuum_every=3))
        rows = table.rows(spark, balances.schema)
        found = {r.participant_id: float(r.balance) for r in rows.collect()}
        batches = 5 * (turn + 1)
        assert found == {**{k: batches for k in range(20)}, None: 2 * batches, **{100 + n: 1 for n in range(batches)}}
        # One file a bucket, though there were as many versions as batches; what is on disk follows the buckets too.
        assert len(rows.inputFiles()) <= 4
    assert len(list((tmp_path / "table" / "rows").rglob("*.parquet"))) <= 4 * 4


def test_a_micro_batch_is_written_and_read_in_many_tasks(spark, tmp_path):
    from turnout.catalog import streams

    rows, sizes = spark.range(0, 8000, 1, 8).withColumn("text", F.repeat(F.lit("x"), 100)), []

    def one_batch(batch, batch_id):
        sizes.append((batch_id, batch.count(), len(list((tmp_path / "in").glob("*.parquet")))))

    for stream in streams._batches(spark, rows, str(tmp_path), F.col("id") % 4):
        run(stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", str(tmp_path / "cp")))
    # Each was one file, written by one task.
    assert [s[:2] for s in sizes] == [(n, 2000) for n in range(4)] and all(s[2] > n + 1 for n, s in enumerate(sizes))
