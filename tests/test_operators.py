from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnout.operators import counts, dedupe, distribution, merge, ordering, overlap, resolve, sessions
from turnout.operators.changes import diff_changes

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def numbers(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, x double")


# --- ordering ------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0, 300])
def test_global_rank_equals_the_window(spark, hot):
    values = [float(i % 37) for i in range(300)] + [5.0] * hot + [None] * 40
    df = numbers(spark, values)
    order = [F.col("x").desc_nulls_last(), F.col("id").asc()]
    got = ordering.global_rank(df, order, ties=["x"], name="r", row_name="n", partitions=7)
    from pyspark.sql import Window

    expected = df.select("id", F.rank().over(Window.orderBy(order[0])).alias("r"),
                         F.row_number().over(Window.orderBy(*order)).alias("n"))
    assert {tuple(r) for r in got.select("id", "r", "n").collect()} == {tuple(r) for r in expected.collect()}


def test_rank_of_one_value_everywhere(spark):
    got = ordering.global_rank(numbers(spark, [1.0] * 100), [F.desc("x"), F.asc("id")], ties=["x"], partitions=5)
    assert {r.rank for r in got.collect()} == {1}


def test_deep_page_equals_shallow_page(spark):
    df = numbers(spark, [float(i % 11) for i in range(200)])
    order = [F.desc("x"), F.asc("id")]
    for ties in (None, ["x"]):
        shallow = ordering.ranked_page(df, order, 20, 30, ties=ties).collect()
        deep = ordering.deep_page(df, order, 20, 30, ties=ties).select(*df.columns, "rank").collect()
        assert {tuple(r) for r in shallow} == {tuple(r) for r in deep} and len(deep) == 20


def test_running_total_by_group(spark):
    data = [("a" if i % 3 else "b", i, i % 5) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, w int")
    got = ordering.running_total(df, [F.col("i")], F.col("w"), "t", by=["g"], total_name="all", partitions=6).collect()
    total: dict[str, int] = {}
    for g, i, w in data:
        total[g] = total.get(g, 0) + w
        assert next(r.t for r in got if (r.g, r.i) == (g, i)) == total[g]
    assert {(r.g, r["all"]) for r in got} == set(total.items())


def test_page_count():
    assert [ordering.page_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


# --- distribution ----------------------------------------------------------------------------


@FEW
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.integers(1, 60))
def test_histogram_counts_every_value(spark, values, bins):
    got = distribution.histogram(numbers(spark, [float(v) for v in values]), "x", bins).orderBy("bin").collect()
    assert sum(r["count"] for r in got) == len(values)
    assert got[0].low == min(values) and got[-1].high == max(values)
    assert len(got) == (1 if len(set(values)) == 1 else bins)


def test_histogram_of_nothing(spark):
    assert distribution.histogram(numbers(spark, [None]), "x").count() == 0
    with pytest.raises(ValueError):
        distribution.histogram(numbers(spark, [1.0]), "x", 0)


def test_percentiles_equal_the_builtin(spark):
    data = [("hot", (i * 7919) % 1000 - 300.5) for i in range(1500)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double")
    near = {r.g: r.p for r in df.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, distribution.QUARTILES))).alias("p")).collect()}
    far = {r.g: r.percentiles for r in distribution.exact_percentiles(df, "x", by=["g"]).collect()}
    assert near.keys() == far.keys() == {"hot", "one", "two"}
    for g in near:
        assert far[g] == pytest.approx(near[g])


def test_score_stats_of_edge_groups(spark):
    df = spark.createDataFrame([("a", Decimal("1.5")), ("a", None), ("b", None)], "g string, s decimal(14,4)")
    got = {r.g: r for r in distribution.score_stats(df, "s", by=["g"]).collect()}
    assert (got["a"].n_scored, got["a"].median, got["a"].stddev_score, got["a"].score_range) == (1, 1.5, None, 0.0)
    assert (got["b"].n_scored, got["b"].median, got["b"].avg_score) == (0, None, None)
    for rows, n in ((df, 1), (df.limit(0), 0)):
        whole = distribution.score_stats(rows, "s").collect()
        assert [r.n_scored for r in whole] == [n] and whole[0].median == (1.5 if n else None)


# --- duplicates and merges ---------------------------------------------------------------------


def test_keep_last_and_first(spark, rows):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), (None, 3, "c"), (None, 4, None)], "k string, o int, v string")
    assert rows(dedupe.keep_last(df, ["k"], ["o"])) == [("k", 2, "b"), (None, 4, None)]
    assert rows(dedupe.keep_first(df, ["k"], ["o"])) == [("k", 1, None), (None, 3, "c")]
    again = dedupe.keep_last(dedupe.keep_last(df, ["k"], ["o"]), ["k"], ["o"])
    assert rows(again) == rows(dedupe.keep_last(df, ["k"], ["o"]))


def test_keep_latest_repoints_children(spark, rows):
    table = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 1)], "id int, k string, t int")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "c int, fk int")
    kept, (moved,) = dedupe.keep_latest_and_repoint(table, ["k"], ["t", "id"], "id", [(child, "fk")])
    assert rows(kept, "id") == [(2,), (3,)]
    assert rows(moved) == [(10, 2), (11, 2), (12, 3), (13, None)]


TABLE = "city string, day date, name string, n decimal(14,4)"


def test_upsert_policies_and_null_keys(spark, rows):
    day = date(2026, 1, 1)
    current = spark.createDataFrame([("a", day, "old", Decimal(1)), ("b", None, "old", Decimal(2))], TABLE)
    incoming = spark.createDataFrame([("b", None, None, Decimal(5)), ("c", None, "new", Decimal(7))], TABLE)

    def run(**policy):
        return rows(merge.upsert(current, incoming, ["city", "day"], **policy), "city", "name", "n", "_action")

    assert run()[1:] == [("b", None, Decimal(5), "update"), ("c", "new", Decimal(7), "insert")]
    assert run(keep_if_null=["name"])[1][1] == "old"
    assert run(additive=["n"])[1][2] == Decimal(7)
    assert run(insert_only=True) == [("a", "old", 1, "keep"), ("b", "old", 2, "keep"), ("c", "new", 7, "insert")]
    once = merge.upsert(current, incoming, ["city", "day"]).drop("_action")
    twice = merge.upsert(once, incoming, ["city", "day"]).drop("_action")
    assert rows(once) == rows(twice)
    touched = merge.upsert(current, incoming, ["city", "day"], touch={"name": F.lit("now")})
    assert rows(touched, "city", "name") == [("a", "old"), ("b", "now"), ("c", "now")]


def test_upsert_of_repeated_keys(spark, rows):
    current = spark.createDataFrame([(1, None, "old", 0)], "k int, j int, v string, o int")
    incoming = spark.createDataFrame([(1, None, "a", 1), (1, None, "b", 2), (2, 3, "c", 9), (2, 3, "d", 8)], "k int, j int, v string, o int")
    got = merge.upsert(current, incoming, ["k", "j"], order=["o"])
    assert rows(got, "k", "v", "_action") == [(1, "b", "update"), (2, "c", "insert")]
    with pytest.raises(Exception, match="repeat a key"):
        merge.upsert(current, incoming, ["k", "j"]).collect()


def test_repeated_dimension_keys_do_not_multiply(spark, rows):
    facts = spark.createDataFrame([(1, "Goa ", None), (2, "goa", 7), (3, "x", None), (4, None, None)], "id int, city string, fk int")
    dim = spark.createDataFrame([(5, "goa"), (4, "GOA"), (9, "y")], "sid int, town string")
    assert rows(merge.relink_by_natural_key(facts, dim, {"city": "town"}, "fk", "sid", lower=["city"]), "id", "fk") == [(1, 4), (2, 7), (3, None), (4, None)]
    scopes = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "c", "r")], "s int, d string, e string")
    batch = spark.createDataFrame([(1, "b", "q", 10), (1, "a", "q", 11), (1, "z", "q", 12), (3, "a", "p", 13), (2, "c", "r", 14)], "s int, d string, e string, id int")
    ok, bad = resolve.scope_gate(batch, scopes, "s", {"d": "d", "e": "e"})
    assert rows(ok, "id") == [(10,), (14,)]
    assert rows(bad, "id", "reason") == [(11, "no scope matches as a whole"), (12, "d does not match scope"), (13, "scope not found")]


def test_replace_slice_leaves_other_slices(spark, rows):
    current = spark.createDataFrame([(1, "x", "one"), (1, "x", "two"), (1, "y", "keep"), (2, "x", "keep")], "s int, k string, e string")
    incoming = spark.createDataFrame([(1, "x", "three")], "s int, k string, e string")
    assert rows(merge.replace_slice(current, incoming, ["s", "k"])) == [(1, "x", "three"), (1, "y", "keep"), (2, "x", "keep")]
    emptied = spark.createDataFrame([(2, "x")], "s int, k string")
    left = merge.replace_slice(current, incoming.limit(0), ["s", "k"], emptied)
    assert len(rows(left)) == 3


def test_append_idempotent(spark, rows):
    history = spark.createDataFrame([("used", 1), (None, 2)], "key string, n int")
    batch = spark.createDataFrame([("used", 3), ("new", 5), ("new", 4), (None, 6), (None, 7)], "key string, n int")
    assert rows(merge.append_idempotent(history, batch, "key", ["n"]), "n") == [(4,), (6,), (7,)]


def test_unlink_then_delete(spark, rows):
    dim = spark.createDataFrame([(1,), (2,)], "id int")
    fact = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "f int, fk int")
    left, facts, report = merge.unlink_then_delete(dim, "id", F.col("id") == 1, {"fact": (fact, "fk")})
    assert rows(left) == [(2,)]
    assert rows(facts["fact"]) == [(10, None), (11, 2), (12, None)]
    assert rows(report) == [("fact", 1)]


def test_patch_by_last_sheet_row(spark, rows):
    current = spark.createDataFrame([("a", 1, None), ("b", 1, 5), ("a", 2, 9)], "e string, r int, n int")
    sheet = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "z", 4), (4, "z", 1)], "o int, e string, n int")
    patched, unmatched = merge.patch_column(current, sheet, ["e"], "n", ["o"], F.col("r") == 1)
    assert rows(patched) == [("a", 1, 3), ("a", 2, 9), ("b", 1, 5)]
    assert tuple(merge.unmatched_report(unmatched, "e", 80).first()) == (2, 1, "z")


PAIRS = st.dictionaries(st.integers(0, 6), st.sampled_from(["u", "v", None]), min_size=1, max_size=6)


@FEW
@given(PAIRS, PAIRS)
def test_changes_rebuild_the_new_rows(spark, old, new):
    schema = "id int, name string"
    diff = diff_changes(
        spark.createDataFrame(list(old.items()), schema), spark.createDataFrame(list(new.items()), schema), ["id"]
    )
    state = dict(old)
    for r in diff.collect():
        key = int(r.record_pk.split(":")[1].rstrip("}"))
        if r.op == "DELETE":
            del state[key]
        elif r.op == "UPDATE":
            assert r.changed_columns == ["name"] and r.changes["name"].old == old[key]
            state[key] = r.changes["name"].new
        else:
            state[key] = new[key]
    assert state == new


def test_change_capture_example(spark):
    schema = "id int, name string, age int"
    alice, older = spark.createDataFrame([(1, "alice", 30)], schema), spark.createDataFrame([(1, "alice", 31)], schema)
    empty = alice.limit(0)
    assert diff_changes(empty, alice, ["id"]).first().op == "INSERT"
    update = diff_changes(alice, older, ["id"]).first()
    assert (update.op, update.changed_columns, update.changes["age"].old, update.changes["age"].new) == ("UPDATE", ["age"], "30", "31")
    assert diff_changes(older, empty, ["id"]).first().op == "DELETE"
    assert diff_changes(alice, alice, ["id"]).count() == 0


# --- overlap -------------------------------------------------------------------------------------


@FEW
@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("cdef")))
def test_overlap_adds_up(spark, a, b):
    def frame(values):
        return spark.createDataFrame([(v,) for v in values] + [(None,), (" ",)], "k string")

    r = overlap.overlap(frame(a), frame(b), "k").first()
    assert (r.n_a, r.n_b, r.both) == (len(set(a)), len(set(b)), len(set(a) & set(b)))
    assert r.both + r.a_only == r.n_a and r.both + r.b_only == r.n_b


def test_cohorts(spark, rows):
    rounds = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "r int, closes int")
    subs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "c")], "r int, e string")
    ordered = overlap.with_prior(rounds, "r", [F.col("closes")])
    got = overlap.cohort_vs_prior(subs, ordered, "r", "e")
    assert rows(got, "r", "prior_r", "distinct_teams", "returning_from_prior", "fresh_vs_prior") == [
        (1, None, 1, 0, 1), (2, 1, 2, 1, 1), (3, 2, 0, 0, 0)]


# --- resolution ------------------------------------------------------------------------------------


def test_best_match_prefers_session_then_undated(spark, rows):
    day = date(2026, 5, 4)
    regs = spark.createDataFrame(
        [("a", 1, None, ""), ("a", 2, day, " Main"), ("b", 3, date(2020, 1, 1), "x"), ("b", 4, None, " "), ("c", 6, None, "q"),
         ("c", 5, date(2020, 1, 1), "x")],
        "e string, id int, d date, l string",
    )
    got = resolve.best_match(regs, "e", "id", "d", "l", F.lit(day), F.lit("main "))
    assert rows(got, "e", "id", "match_rank") == [("a", 2, 0), ("b", 4, 1), ("c", 5, 2)]


def test_required_reference_policies(spark, rows):
    ref = spark.createDataFrame([("a", "Ann", "x")], "email string, name string, src string")
    subs = spark.createDataFrame([(1, "a", "A"), (2, "z", "Zed"), (3, "z", "Zoe")], "n int, lead string, who string")
    with pytest.raises(ValueError):
        resolve.resolve_required(subs, ref, "lead", "email", "error")
    assert rows(resolve.resolve_required(subs, ref, "lead", "email", "skip")[0], "n") == [(1,)]
    kept, missing, created = resolve.resolve_required(
        subs, ref, "lead", "email", "create", {"name": "who"}, ["n"], {"src": F.lit("auto")})
    assert kept.count() == 3 and rows(missing) == [("z",)] and rows(created) == [("z", "Zed", "auto")]


def test_natural_key_fallback(spark, rows):
    facts = spark.createDataFrame([(1, 7, "x"), (2, None, "pune"), (3, None, "none")], "f int, sid int, city string")
    dim = spark.createDataFrame([(7, "delhi", "D"), (8, "pune", "P")], "id int, town string, label string")
    got = resolve.natural_key_fallback(facts, dim, "sid", "id", {"city": "town"}, ["label"])
    assert rows(got, "f", "label") == [(1, "D"), (2, "P"), (3, None)]


def test_funnel_pairs(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1)], "u string, c int")
    b = spark.createDataFrame([("a", 1), ("z", 2)], "u string, c int")
    assert tuple(resolve.pair_stats(a, b, ["u", "c"]).first()) == (2, 2, 1, 1, 1)
    allowed = spark.createDataFrame([(1,)], "id int")
    assert resolve.missing_references(b, allowed, "c", "id").first().c == 2


# --- counts and sessions -----------------------------------------------------------------------------


def test_counts_not_after(spark, rows):
    points = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 2, 5)] + [(None,)], "t timestamp_ntz")
    moments = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 2, 3, 9)] + [(None,)], "m timestamp_ntz")
    assert [n for _, n in rows(counts.counts_not_after(points, "t", moments, "m"), "m", "n")] == [1, 3, 3, 4]
    tagged = points.withColumn("g", F.lit(1)).unionByName(points.limit(2).withColumn("g", F.lit(None).cast("int")))
    asked = moments.withColumn("g", F.lit(1)).unionByName(moments.withColumn("g", F.lit(2)))
    got = rows(counts.counts_not_after(tagged, "t", asked, "m", by=["g"]), "g", "m", "n")
    assert [(g, n) for g, _, n in got] == [(1, 1), (1, 3), (1, 3), (1, 4), (2, 0), (2, 0), (2, 0), (2, 0)]


def test_round_counts_with_open_bounds(spark):
    regs = spark.createDataFrame([(5, datetime(2024, 1, 1)), (5, datetime(2024, 1, 3)), (6, datetime(2024, 1, 2))], "event_id int, form_timestamp timestamp_ntz")
    rounds = spark.createDataFrame([(1, 5, None, datetime(2024, 1, 3)), (2, 5, datetime(2024, 1, 2), None), (3, 6, datetime(2024, 1, 1), datetime(2024, 1, 3))],
                                   "id int, event_id int, opens_at timestamp_ntz, closes_at timestamp_ntz")
    got = {r.id: (r.registrations_at_open, r.registrations_at_close) for r in sessions.round_counts(rounds, regs).collect()}
    assert got == {1: (None, 2), 2: (1, None), 3: (0, 1)}


@pytest.mark.parametrize("today, expected", [(date(2026, 5, 1), 3), (date(2026, 5, 16), 1), (date(2020, 1, 1), 4)])
def test_default_session(spark, today, expected):
    options = spark.createDataFrame(
        [(1, date(2026, 5, 16), 1), (2, date(2026, 5, 4), 9), (3, date(2026, 4, 25), 2), (4, date(2026, 4, 12), 8), (5, date(2026, 4, 25), 1)],
        "id int, d date, n int")
    assert sessions.default_session(options, "d", today, "id", "n").first().id == expected


@pytest.mark.parametrize("requested, configured, expected", [(2, None, 2), (99, 2, 3), (None, 1, 1), (None, 99, 3)])
def test_round_choice(spark, requested, configured, expected):
    rounds = spark.createDataFrame([(1, "draft", None), (2, "closed", None), (3, "live", None)], "id int, status string, opens_at timestamp_ntz")
    assert sessions.pick_round(rounds, requested, configured).first().id == expected


def test_facets_and_options(spark, rows):
    df = spark.createDataFrame([("b ", "x"), ("a", ""), ("b", None), ("c", "y")], "p string, q string")
    assert rows(counts.facet_values(df, ["p", "q"], 2)) == [("p", "a"), ("p", "b"), ("q", "x"), ("q", "y")]
    got = [r.value for r in counts.options_with_extras(df, "p", ["B", "Zed"]).collect()]
    assert got == ["a", "b", "c", "Zed"]


def test_state_aliases(spark, rows):
    df = spark.createDataFrame([("Orissa", 2), ("odisha ", 3), ("NCT_of_Delhi", 1), ("Atlantis", 9)], "s string, n int")
    got = rows(counts.alias_rollup(df, "s", "n", ["Odisha", "Delhi", "Goa"], counts.STATE_ALIASES))
    assert got == [("Delhi", 1), ("Goa", 0), ("Odisha", 5)]


def _window_tasks(spark, frame):
    """How many tasks hold rows of a frame, with no partitions joined."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        return frame.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(name, "true")


@pytest.mark.parametrize("sign", [1, -1])
def test_close_values_are_walked_by_many_tasks(spark, sign):
    # All values lie within a thousandth of each other, in one coarse bucket or two.
    hot = spark.range(6000).select(F.lit("a").alias("g"), (F.lit(1000.0 * sign) + F.col("id") / 12000).alias("v"))
    few = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, v double")
    got = {r.g: r.percentiles for r in distribution.exact_percentiles(hot.unionByName(few), "v", (0.25, 0.5, 0.9), ["g"]).collect()}
    values = sorted(1000.0 * sign + i / 12000 for i in range(6000))
    assert got[None] == pytest.approx([1.5, 2.0, 2.8])
    assert got["a"] == pytest.approx([values[int(p * 5999)] + (p * 5999 % 1) / 12000 for p in (0.25, 0.5, 0.9)], abs=1e-9)
    counted = hot.withColumn("c", F.lit(1))
    run = ordering.bucketed_total(counted, [F.col("v")], distribution.value_levels(F.col("v")), F.col("c"), "n", ["g"], "all")
    assert _window_tasks(spark, run) > 1
    assert hot.select(distribution.value_levels(F.col("v"))[0]).distinct().count() <= 2
    assert [r.n for r in run.orderBy("v").collect()] == list(range(1, 6001)) and run.select("all").distinct().first()[0] == 6000


def test_moments_of_one_day_are_counted_by_many_tasks(spark):
    start = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    points = spark.range(5000).select(F.lit(1).alias("g"), (start + F.make_dt_interval(secs=F.col("id") * 16)).alias("ts"))
    moments = points.where("second(ts) = 0").select("g", F.col("ts").alias("at"))
    found = counts.counts_not_after(points, "ts", moments, "at", by=["g"])
    assert _window_tasks(spark, found) > 1
    seconds = lambda t: t.hour * 3600 + t.minute * 60 + t.second
    assert all(r.n == seconds(r["at"]) // 16 + 1 for r in found.collect()) and found.count() == moments.count()
