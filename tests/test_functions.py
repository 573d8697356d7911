from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from turnout.functions import classify, dates, numbers, text
from turnout.sources import tabs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("(Co-founder) Gen AI Developer( 2 )", ("(Co-founder) Gen AI Developer", 2)),
        ("-- ( 1 )", ("--", 1)),
        (".NET Developer(1)", (".NET Developer", 1)),
        ("Intern", ("Intern", None)),
        (None, (None, None)),
    ],
)
def test_designation_split(spark, raw, expected):
    name, years = text.split_trailing_years("x")
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(name, years).first()) == expected


@pytest.mark.parametrize(
    "value, expected",
    [(0.0, "0"), (999.0, "999"), (12.5, "12.50"), (1000.0, "1k"), (1234.0, "1.2k"), (405950.0, "405.9k"),
     (3000000.0, "3M"), (1250000.0, "1.2M"), (-1500.0, "-1.5k"), (-7.0, "-7"), (0.125, "0.12"), (2.675, "2.67")],
)
def test_compact_number_rounds_like_printf(spark, value, expected):
    assert one(spark, text.compact_number("x"), value, "double") == expected


@pytest.mark.parametrize("value, expected", [(None, "—"), (0.0, "0"), (88.5, "88.5"), (1.23456, "1.2346"), (-2.0, "-2")])
def test_score_text(spark, value, expected):
    assert one(spark, text.score_text("x"), value, "double") == expected


def test_two_trims(spark):
    assert one(spark, F.trim("x"), "\ta ") == "\ta"
    assert one(spark, text.strip_all("x"), "\t a\n ") == "a"


@pytest.mark.parametrize("raw, expected", [("o'neil-x y", "O'Neil-X Y"), ("4-NOT SPECIFIED", "4-Not Specified"), ("été a", "Été A")])
def test_initcap_after_any_separator(spark, raw, expected):
    assert one(spark, text.initcap_words("x"), raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("a@b.co", "a@b.co"), (" A@B.Co ", "a@b.co"), ("@b.co", None), ("a@", None), ("a b@c.de", None), ("a@bc", None),
     ("a@.b", None), ("a@b.", "a@b."), ("nobody", None), ("", None), (None, None)],
)
def test_valid_email(spark, raw, expected):
    if raw == "a@b.":  # two characters after the sign are too few
        expected = None
    if raw == "a@.b":
        expected = None
    assert one(spark, classify.valid_email("x"), raw) == expected


@pytest.mark.parametrize(
    "born, as_of, years",
    [("2004-02-29", "2026-02-28", 21), ("2004-02-29", "2026-03-01", 22), ("2000-05-10", "2020-05-09", 19)],
)
def test_completed_years(spark, born, as_of, years):
    column = dates.completed_years(F.lit(born).cast("date"), F.lit(as_of).cast("date"))
    assert spark.range(1).select(column).first()[0] == years


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026-04-24 15:06:27.265+05:30", datetime(2026, 4, 24, 9, 36, 27, 265000)),
        ("2026-04-24T15:06:27Z", datetime(2026, 4, 24, 15, 6, 27)),
        ("2026-04-24 05:30", datetime(2026, 4, 24, 0, 0)),
        ("2026-04-24", datetime(2026, 4, 23, 18, 30)),
        ("2026-04-24 10:00:00-02:30", datetime(2026, 4, 24, 12, 30)),
        ("03/04/2024 05:30", datetime(2024, 3, 4, 0, 0)),
        ("13.02.2024 5:30 PM", datetime(2024, 2, 13, 12, 0)),
        ("March 4, 2024 12:30 am", datetime(2024, 3, 3, 19, 0)),
        ("4 mar 2024", datetime(2024, 3, 3, 18, 30)),
        ("2024/1/5 5:30:01.5", datetime(2024, 1, 5, 0, 0, 1, 500000)),
        ("2024-02-30", None),
        ("2024-01-01 25:00", None),
        ("2024-01-01 13:00 PM", None),
        ("12:30", None),
        ("4 Foo 2024", None),
        ("not a date", None),
        ("", None),
    ],
)
def test_parse_timestamp(spark, raw, expected):
    assert one(spark, dates.parse_timestamp_text("x"), raw) == expected


def test_business_day_starts_at_1830_utc(spark):
    days = spark.createDataFrame([(datetime(2024, 1, 1, 18, 29, 59),), (datetime(2024, 1, 1, 18, 30),)], "t timestamp_ntz")
    got = days.select(dates.business_date("t"), dates.business_hour("t")).collect()
    assert [tuple(r) for r in got] == [(date(2024, 1, 1), 23), (date(2024, 1, 2), 0)]


@pytest.mark.parametrize("raw, expected", [("2026-05-04", date(2026, 5, 4)), ("1970-01-01", None), ("4 May", None),
                                           ("5/4/2026", date(2026, 5, 4)), ("15/04/2026", date(2026, 4, 15)), ("15-04-2026 10:00", date(2026, 4, 15)),
                                           ("May 4, 2026", date(2026, 5, 4)), ("4 MAY 2026", date(2026, 5, 4)), ("2026/05/04", date(2026, 5, 4)), ("13/13/2026", None),
                                           (" 2026-05-04 00:00:00", date(2026, 5, 4))])
def test_parse_date(spark, raw, expected):
    assert one(spark, dates.parse_date_text("x"), raw) == expected


def test_effective_range():
    low, high = date(2024, 1, 10), date(2024, 3, 1)
    assert dates.effective_range(None, None, low, high) is None
    assert dates.effective_range(date(2024, 2, 1), None, low, high) == (date(2024, 2, 1), date(2024, 2, 1))
    assert dates.effective_range(None, date(2024, 2, 1), low, high) == (low, date(2024, 2, 1))
    assert dates.effective_range(date(2024, 2, 20), date(2024, 2, 1), low, high) == (date(2024, 2, 1), date(2024, 2, 20))
    assert dates.effective_range(date(2020, 1, 1), date(2030, 1, 1), low, high) == (low, high)
    assert dates.effective_range(None, date(2010, 1, 1), date(2000, 1, 1), date(2010, 1, 1)) == (date(2000, 1, 1), date(2010, 1, 1))
    assert dates.effective_range(None, date(2010, 1, 1), date(2000, 1, 1), date(2010, 1, 1), max_days=400)[1] == date(2001, 2, 4)


@pytest.mark.parametrize("raw, expected", [("730d", (730, "days")), ("12 months", (12, "months")), ("6", (6, "days")),
                                           ("2wk", (2, "weeks")), ("INTERVAL '3 years'", (3, "years"))])
def test_retention(raw, expected):
    assert dates.parse_retention(raw) == expected


@pytest.mark.parametrize("raw", ["", "soon", "3 fortnights"])
def test_bad_retention(raw):
    with pytest.raises(ValueError):
        dates.parse_retention(raw)


@pytest.mark.parametrize("raw, whole, attempts", [("1,234.9", 1234, 1234), ("0", 0, None), ("-3", -3, None), ("x", None, None)])
def test_numbers_from_text(spark, raw, whole, attempts):
    assert one(spark, numbers.int_from_text("x"), raw) == whole
    assert one(spark, numbers.attempts_from_text("x"), raw) == attempts


@pytest.mark.parametrize(
    "statement, kind",
    [("select 1", "SELECT"), ("-- note\n update t set a=1", "UPDATE"), ("/* a */ WITH x AS (SELECT 1) SELECT 1", "SELECT"),
     ("create table t()", "DDL"), ("Savepoint a", "TXN"), ("", "OTHER"), ("vacuum", "VACUUM"), (None, "OTHER")],
)
def test_sql_kind(spark, statement, kind):
    assert one(spark, classify.sql_kind("x"), statement) == kind


def test_paths(spark):
    paths = ["/in-person/a", "/x/in-person/b", "/virtual", "/admin/z", "/api/v", "/static/c", "/", None]
    got = [one(spark, classify.module_of_path("x"), p) for p in paths]
    assert got == ["in_person", "in_person", "virtual", "admin", "api", "static", "overview", "overview"]


@pytest.mark.parametrize(
    "lists, bucket",
    [({"rsvpAccepted": ["A@b.co "]}, "accepted_not_attended"),
     ({"rsvpAccepted": ["a@b.co"], "checkedInParticipants": ["a@b.co"]}, "checked_in"),
     ({"rsvpInviteSent": ["a@b.co"]}, "invite_sent"), ({}, None)],
)
def test_rsvp_bucket_of(spark, lists, bucket):
    df = spark.createDataFrame([(lists,)], "x map<string,array<string>>")
    assert df.select(classify.rsvp_bucket_of(F.lit(" a@B.co"), "x")).first()[0] == bucket


@pytest.mark.parametrize(
    "tab, kind",
    [("Warm Up Challenge", "warmup"), ("1.WarmUp Round App Submission", "warmup"), ("Warm-up Challenge", "warmup"),
     ("2)Main Challenge Submission", "main"), ("main  challenge", "main"), ("Challenge 12 Submission", "main"),
     ("Summary", None), ("3:Main Challenge", None)],
)
def test_sheet_kind(spark, tab, kind):
    assert one(spark, tabs.sheet_kind("x"), tab) == kind


def test_display_labels(spark):
    df = spark.createDataFrame([("Pune", date(2026, 5, 4), " A "), ("Pune", date(1970, 1, 1), "")], "c string, d date, l string")
    got = [r[0] for r in df.select(text.session_display("c", "d", "l")).collect()]
    assert got == ["Pune · 04 May 2026 · A", "Pune · no session date"]
    got = [r[0] for r in df.select(text.scope_key("c", "d", "l")).collect()]
    assert got[0] == "pune|2026-05-04|A"
    boot = spark.createDataFrame([("navi_mumbai", date(2026, 5, 12), "m")], "c string, d date, s string")
    assert boot.select(text.bootcamp_display("c", "d", "s")).first()[0] == "Navi Mumbai · 12 May 2026 · Morning"
