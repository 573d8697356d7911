from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnout.catalog import QUERIES, base
from turnout.operators import roster
from turnout.operators.roster import RosterFilter, apply_filter, best_score, roster_page, sort_columns
from turnout.plans import activity, dashboard, leaderboards, reports, stats
from turnout.plans.crossover import CrossoverParams, crossover
from turnout.plans.dashboard import overview, registration_dashboard
from turnout.plans.ledger import grant_credits

SF = "/root/testdata/sf0.001"
SUBS = ("id int, event_id int, challenge_id int, registration_id int, team_name string, leader_name string, leader_email string, "
        "leader_email_normalized string, total_score decimal(14,4), export_created_at timestamp_ntz, attempts_completed int, "
        "attendance_city string, session_on date, session_label string, sheet_kind string, deployed_link string, imported_at timestamp_ntz")
REGS = ("id int, event_id int, email string, email_normalized string, full_name string, profile_name string, mobile string, occupation string, "
        "city string, state string, country string, attendance_city string, utm_source string, gender string, dob date, "
        "designation string, designation_years int, form_timestamp timestamp_ntz, updated_at timestamp_ntz, session_on date, session_label string")


def sub(i, leader, score, round_id=1, at=None, reg=None, city="Pune", on=None, label="", kind="main"):
    score = None if score is None else Decimal(str(score))
    return (i, 1, round_id, reg, f"T{i}", leader.upper(), f"{leader}@X.co", f"{leader}@x.co", score, at, None, city, on, label, kind, " ", at)


def reg(i, email, occupation=None, city="Pune", at=None, dob=None, **more):
    return (i, 1, email, email.lower(), f"Name {i}", None, None, occupation, city, "goa", "India", more.get("attendance"), None, "", dob,
            "Dev", i, at, at, more.get("on"), more.get("label", ""))


@pytest.fixture
def subs(spark):
    day = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [sub(1, "a", 10, at=day), sub(2, "b", 10, at=None), sub(3, "c", None, at=day), sub(4, "d", 50, at=day),
         sub(5, "a", None, round_id=2, at=datetime(2025, 1, 1)), sub(6, "e", 10, at=day)], SUBS)


def test_round_leaderboard_order(subs):
    got = leaderboards.round_leaderboard(subs.where("challenge_id = 1"), 10).orderBy("rank").collect()
    assert [(r.rank, r.team_name) for r in got] == [(1, "T4"), (2, "T1"), (3, "T6"), (4, "T2"), (5, "T3")]


def test_global_leaderboard_counts_missing_as_zero(subs):
    got = {r.leader_email_normalized: r for r in leaderboards.global_leaderboard(subs, 10).collect()}
    a = got["a@x.co"]
    assert (a.average_score, a.arena_count, a.team_name, a.submitted_at) == (5.0, 2, "T1", datetime(2025, 1, 1))
    assert got["d@x.co"].rank == 1 and got["c@x.co"].average_score == 0.0


def test_session_scope_for_dated_and_undated(spark):
    day = date(2026, 5, 4)
    df = spark.createDataFrame(
        [sub(1, "a", 1, on=day), sub(2, "b", 2, on=None), sub(3, "c", 3, on=day, label=" Eve "), sub(4, "d", 4, on=day, kind="warmup"),
         sub(5, "e", 5, on=None, label="x")], SUBS)

    def teams(*scope, **more):
        return {r.team_name for r in leaderboards.session_leaderboard(df, leaderboards.session_scope(*scope, **more)).collect()}

    assert teams(" pune ", day) == {"T1"}
    assert teams("Pune", day, "eve") == {"T3"}
    assert teams("Pune") == {"T2"}
    assert teams("Pune", every_date=True) == {"T1", "T2", "T3", "T5"}


def test_crossover(spark):
    ip = spark.createDataFrame(
        [sub(1, "a", 1, city="Pune"), sub(2, "a", 1, city="Delhi "), sub(3, "b", 1, city=" "), sub(4, "b", 1, city="Pune"),
         sub(5, "c", 1, city="Pune"), sub(6, "d", 1, kind="warmup")], SUBS)
    v = spark.createDataFrame([sub(7, "a", 1), sub(8, "b", 1), sub(9, "z", 1), sub(10, "d", 1)], SUBS)
    params = CrossoverParams.from_request({"sheet_kind": " MAIN", "in_person_event_id": "1", "city_limit": "900"}, 9, 1)
    assert (params.sheet_kind, params.city_limit) == ("main", 900)
    counts, cities = crossover(ip, v, params)
    assert tuple(counts.first()) == (3, 4, 2, 1, 2)
    assert [tuple(r) for r in cities.collect()] == [("Delhi", 1)]
    assert CrossoverParams.from_request({"virtual_event_id": "0"}, 1, 1) is None
    chosen = CrossoverParams.from_request({"round_ids": "3, 4 x", "label": ""}, 1, 1)
    assert chosen.round_ids == (3, 4) and chosen.label == ""


def test_session_stats(spark):
    day, before = date(2026, 5, 4), date(2026, 4, 4)
    regs = spark.createDataFrame(
        [reg(1, "a@x.co", "Student ", attendance="Pune", on=day), reg(2, "b@x.co", "Startup", attendance="pune ", on=day),
         reg(3, "c@x.co", None, attendance="Pune", on=None)], REGS)
    df = spark.createDataFrame(
        [sub(1, "a", 5, reg=1, on=day), sub(2, "b", 7, reg=2, on=day), sub(3, "z", None, on=day), sub(4, "a", 1, on=before, city="Goa")], SUBS)
    sessions = spark.createDataFrame([(1, 1, "goa", before, ""), (2, 1, "pune", day, "")], "id int, event_id int, city string, session_on date, session_label string")
    got = stats.session_stats(df, regs, sessions, "Pune", day, "")
    assert got["registrations"].first()[0] == 2
    assert tuple(got["totals"].first()) == (3, 2, 2)
    assert tuple(got["segments"].first()) == (1, 1, 1, 0)
    scores = got["scores"].first()
    assert (scores.n_scored, scores.median, scores.score_range) == (2, 6.0, 2.0)
    cohort = got["cohort"].first()
    assert (cohort.prior_session_id, cohort.distinct_teams, cohort.returning_from_prior) == (1, 3, 1)
    assert {r.segment: r.n for r in got["attempts"].collect()} == {"student": 1, "professional": 1}
    undated = stats.session_registrations(regs, "Pune", None, None).first()[0]
    assert undated == 1


def test_dashboard_and_overview(spark, subs):
    regs = spark.createDataFrame(
        [reg(1, "a@x.co", at=datetime(2026, 1, 10, 18, 30), dob=date(2000, 1, 16)), reg(2, "b@x.co", at=datetime(2026, 1, 1)),
         reg(3, "q@x.co", at=None, dob=date(2000, 1, 15))], REGS)
    now = datetime(2026, 1, 15)
    all_time = registration_dashboard(regs, now, "virtual", other_track=subs.withColumnRenamed("leader_email_normalized", "email_normalized"),
                                      ip_subs=subs)
    totals = all_time["totals"].first()
    assert (totals.total, totals.last_7_days, totals.average_age, totals.with_dob) == (3, 1, 25.5, 2)
    assert all_time["timeline"].count() == 120 and all_time["hourly"].agg(F.sum("n")).first()[0] == 2
    assert tuple(all_time["track_overlap"].first())[:3] == (3, 5, 2)
    assert all_time["led_in_person"].first()[0] == 2
    ranged = registration_dashboard(regs, now, "virtual", date_from=date(2026, 1, 5), date_to=date(2026, 1, 20))
    assert ranged["totals"].first().total == 1
    assert [(r.day, r.n) for r in ranged["timeline"].orderBy("day").collect()][-1] == (date(2026, 1, 11), 1)
    assert ranged["last_7_days"].first()[0] == 1
    ledger = spark.createDataFrame([(Decimal("2.5"),)], "delta decimal(14,4)")
    page = overview(regs, subs, subs, ledger, now, 1)
    assert page["counts"].first().conversion_pct == 166.67
    assert page["round_scores"].first().scored_n == 4 and page["global_leaderboard"].count() == 5


def test_roster_filter_parsing():
    spec = RosterFilter.from_request({"designation_years_min": "9", "designation_years_max": "2", "dob_from": "x", "af_city": " Pune ",
                                      "form_ts_to": "2026-01-05", "segment": "other", "segment_round": "3", "attempts": "2"})
    assert (spec.years_min, spec.years_max, spec.born_from, dict(spec.facets)) == (2, 9, None, {"city": "Pune"})
    assert spec.registered_to == datetime(2026, 1, 5, 23, 59, 59, 999999)
    assert (spec.segment_round, spec.attempts) == (3, None)
    assert RosterFilter.from_request({"segment": "student", "attempts": "0"}).attempts == 0


def test_roster_segments_scores_and_pages(spark):
    regs = spark.createDataFrame([reg(i, f"m{i}@x.co", "student" if i % 2 else None) for i in range(1, 31)], REGS)
    df = spark.createDataFrame([sub(1, "m1", 5, reg=1), sub(2, "m2", 9, reg=4), sub(3, "m7", 3, reg=None), sub(4, "m1", 8, reg=None)], SUBS)

    def ids(**spec):
        return {r.id for r in apply_filter(regs, RosterFilter(**spec), df).collect()}

    assert ids(participated_round=1) == {1, 2, 4, 7}
    assert ids(segment_round=1, segment="student") == {1}
    assert ids(segment_round=1, segment="other") == {4}
    assert ids(segment_round=1, segment="unknown") == {1, 7}
    assert ids(segment_round=1, segment="student", attempts=0) == {1}
    assert ids(search="M1@") == {1}
    scored = best_score(regs, df)
    assert {r.id: r.submission_score for r in scored.where("submission_score IS NOT NULL").collect()} == {1: 8, 2: 9, 4: 9, 7: 3}
    page = roster_page(scored, sort_columns("score", "desc"), page=1, per_page=3)
    assert (page.total, page.pages, page.per_page) == (30, 10, 3)
    assert [r.id for r in page.rows.orderBy("row").collect()] == [4, 2, 1]
    assert [r.id for r in roster_page(regs, sort_columns("nope", "asc"), 3, 10).rows.collect()][-1] == 1


def test_grants(spark):
    rounds = spark.createDataFrame([(1, 2, datetime(2026, 1, 10)), (3, 1, datetime(2026, 1, 10))], "id int, event_id int, closes_at timestamp_ntz")
    programmes = spark.createDataFrame([(1, "in_person"), (2, "virtual")], "id int, kind string")
    people = spark.createDataFrame([(1, "A@x.co"), (2, "b@x.co"), (3, None)], "id int, email string")
    regs = spark.createDataFrame([(2, "a@x.co", datetime(2026, 1, 10)), (1, "a@x.co", datetime(2026, 1, 1)), (2, "b@x.co", datetime(2026, 1, 11)), (1, "b@x.co", datetime(2026, 1, 2))],
                                 "event_id int, email_normalized string, form_timestamp timestamp_ntz")
    ledger = spark.createDataFrame([("old",)], "idempotency_key string")
    balances = spark.createDataFrame([(1, 2, Decimal(5))], "participant_id int, event_id int, balance decimal(14,4)")
    grants = spark.createDataFrame(
        [(1, 1, 2.0, "r", 1, None, "k1", False), (2, 1, 9.0, "r", 1, None, "k1", False), (3, 1, 1.0, "r", None, 2, None, None),
         (4, 1, 1.0, "r", None, 1, None, None), (5, 2, 1.0, "r", 1, None, None, False), (6, 2, 4.0, "r", 1, None, None, True),
         (7, 1, 1.0, "", 1, None, None, None), (8, 1, 1.0, "r", 99, None, None, None), (9, 1, 1.0, "r", None, None, None, None),
         (10, 1, 1.0, "r", 1, None, "old", None), (11, 1, 1.0, "r", None, 7, None, None),
         (12, 1, 1.0, "r", 3, None, None, False), (13, 2, 1.0, "r", 1, None, "k1", False), (14, 2, 1.0, "r", 1, None, "k2", False),
         (15, 1, 1.0, "r", 1, None, "k2", False), (16, 2, 1.0, "r", 99, None, "old", False)],
        "row_no int, participant_id int, delta double, reason string, challenge_id int, event_id int, idempotency_key string, force boolean")
    out = grant_credits(grants, ledger, balances, rounds, programmes, people, regs)
    assert {(r.participant_id, r.balance, r._action) for r in out.balances.collect()} == {(1, 9, "update"), (2, 4, "insert")}
    assert {r.row_no: r.reason_rejected for r in out.rejects.collect()} == {
        2: "duplicate", 4: "not_virtual", 5: "participant ineligible for challenge", 7: "incomplete", 8: "unknown_round",
        9: "no_target", 10: "duplicate", 11: "unknown_programme", 12: "participant ineligible for challenge", 13: "duplicate",
        14: "participant ineligible for challenge", 16: "duplicate"}
    assert [r.force_ineligible for r in out.ledger.where("participant_id = 2").collect()] == [True]


def test_log_window():
    assert [activity.window_hours(x) for x in (None, "", "x", "0", "-3", "5", "99999")] == [168, 168, 168, None, None, 5, 99999]


def test_report_sections(spark, subs, tmp_path):
    regs = spark.createDataFrame([reg(1, "a@x.co", at=datetime(2026, 1, 1))], REGS)
    rounds = spark.createDataFrame([(2, 1, None, datetime(2026, 2, 1)), (1, 1, datetime(2026, 1, 1), datetime(2026, 1, 2))],
                                   "id int, event_id int, opens_at timestamp_ntz, closes_at timestamp_ntz")
    sections = reports.report_sections(regs, regs, subs, subs, rounds, datetime(2026, 1, 3))
    assert list(sections) == ["Summary", "InPerson", "Cities", "Top10", "Virtual", "Challenges", "Teams", "Retention"]
    reports.export_report({k: sections[k] for k in ("Summary", "Teams", "Retention")}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "Teams" / "challenge_id=1")).count() == 5
    assert tuple(spark.read.parquet(str(tmp_path / "report" / "Retention")).first()) == (5, 1, 1, 1)
    reports.export_csv(regs, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_bytes().decode()
    assert text.startswith("﻿id,email") and ",,Pune" not in text.split("\n")[0]


NO_NESTED_LOOP = ("roster_best_score", "roster_participated", "eligible_counts", "eligible_submissions", "track_overlap", "upsert_keep_if_null",
                  "best_match_registration", "participation_union", "score_histogram", "cohort_vs_prior_round", "registrations_by_moment")


@pytest.mark.parametrize("name", NO_NESTED_LOOP)
def test_plans_have_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_facets_are_cut_before_the_shuffle(spark):
    from turnout.operators.counts import facet_values

    df = spark.createDataFrame([("a", "b")], "p string, q string")
    plan = facet_values(df, ["p", "q"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_log_search_reads_the_months_it_needs(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2025, m, 3), "VIEW", f"2025-{m:02d}") for m in (1, 5, 6)], "occurred_at timestamp_ntz, action string, month string")
    rows.write.partitionBy("month").parquet(str(tmp_path / "log"))
    log = spark.read.schema("occurred_at timestamp_ntz, action string, month string").parquet(str(tmp_path / "log"))
    found = activity.activity_search(log, action="VIEW", start=activity.since(datetime(2025, 6, 5), 24 * 20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [isnotnull(month" in plan and ">= 2025-05" in plan


def test_scans_read_only_what_is_used(spark):
    plan = QUERIES["track_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters: [IsNotNull(o_orderstatus)" in plan


def _scans(frame, table):
    """How many scans of a table a frame's physical plan holds, steps it reuses left out."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and f"/{table}.parquet" in line for line in text.split("\n"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_facts_are_scanned_once(spark):
    folder = "/root/testdata/sf0.001"
    union = QUERIES["participation_union"](spark, folder)
    # In-person submissions, the sessions they were at, virtual submissions; of customers, the registrations of either track besides.
    assert _scans(union, "orders") <= 3 and _scans(union, "customer") <= 4
    assert _scans(QUERIES["cohort_vs_prior_session"](spark, folder), "orders") <= 1
    # What a batch of grants gives is read from the pinned batch alone.
    balances = QUERIES["grant_credits_balances"](spark, folder)
    assert _scans(balances, "events") == 0 and _scans(QUERIES["grant_credits_rejects"](spark, folder), "customer") == 0
    assert _scans(QUERIES["dashboard_label_counts"](spark, folder), "customer") == 1


def test_participation_counts_each_place_once(spark, rows):
    regs = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, None, 11), (4, "d", None)], "id int, email_normalized string, session_id int")
    ip = spark.createDataFrame([(1, 10), (1, 12), (2, 12), (2, 12), (9, 12), (None, 12), (3, None)], "registration_id int, session_id int")
    v_regs = spark.createDataFrame([(1, "v"), (2, "a")], "id int, email_normalized string")
    v = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (2, "b", 6), (None, "c", 5), (None, "c", 5), (None, None, 7), (7, "e", 8), (None, "c", None)],
                              "registration_id int, leader_email_normalized string, challenge_id int")
    found = roster.participation(regs, ip, v, v_regs)
    assert rows(found) == [("a", 2, 2), ("b", 1, 1), ("c", 0, 1), ("e", 0, 1), ("v", 0, 1)]


def test_dashboard_labels_agree_with_each_count(spark):
    regs = base.registrations(spark, "/root/testdata/sf0.001") if Path("/root/testdata/sf0.001").exists() else pytest.skip("no test tables")
    out = dashboard.registration_dashboard(regs, datetime(2001, 1, 15))
    labels = {}
    for r in out["labels"].orderBy("facet", "rank").collect():
        labels.setdefault(r.facet, []).append((r.label, r.n))
    for name in dashboard.dashboard_facets("in_person"):
        assert labels[name] == [(r.label, r.n) for r in out[name].collect()], name
