from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from turnout.operators.resolve import bootcamp_rules, email_list, validate_rows
from turnout.sources import headers, payloads, sheets, tabs
from turnout.sources.files import file_manifest, listed_files, read_csv_records, read_csv_strings, whole_manifest, with_status


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def registrations(spark, tmp_path, *lines):
    return sheets.parse_registrations(read_csv_strings(spark, write(tmp_path, "r.csv", *lines)), ["Programme"])


def test_minimal_registration(spark, tmp_path):
    rows, stats = registrations(
        spark, tmp_path,
        '﻿Timestamp,Email,Full Name,"In which city, would you like to attend the in-person final?"',
        "2026-01-15,a@example.com,Ada Lovelace,Mumbai",
    )
    row = rows.first()
    assert (row.email, row.full_name, row.attendance_city) == ("a@example.com", "Ada Lovelace", "Mumbai")
    assert row.session_on is None and row.session_label == ""
    assert row.form_timestamp == datetime(2026, 1, 14, 18, 30)
    assert stats.first().rows_read == 1


def test_blank_email_is_skipped_and_last_duplicate_wins(spark, tmp_path):
    rows, stats = registrations(spark, tmp_path, "Email,Full Name", "'',x".replace("'", '"'), "c@example.com,First",
                                "c@example.com,Second", "C@example.com,Other")
    assert {(r.email, r.full_name) for r in rows.collect()} == {("c@example.com", "Second"), ("C@example.com", "Other")}
    assert tuple(stats.first()) == (4, 1, 2, 1)


def test_two_dates_stay_two_rows(spark, tmp_path):
    rows, stats = registrations(spark, tmp_path, "Email,Programme Date", "a@b.co,2026-03-28", "a@b.co,2026-05-04")
    assert {r.session_on for r in rows.collect()} == {date(2026, 3, 28), date(2026, 5, 4)}
    assert stats.first().rows_collapsed == 0


def test_header_aliases_keep_text(spark, tmp_path):
    rows, _ = registrations(spark, tmp_path, "Email,UTM  Source,Mobile Number", "x@y.com,newsletter,0123")
    row = rows.first()
    assert (row.utm_source, row.mobile) == ("newsletter", "0123")


def test_missing_email_header(spark, tmp_path):
    with pytest.raises(ValueError, match="email"):
        registrations(spark, tmp_path, "Full Name", "Alice")


def test_last_of_several_headers_wins(spark, tmp_path):
    raw = read_csv_strings(spark, write(tmp_path, "d.csv", "Email,PW Session,PW Session Label,EMAIL", "a@b.co,one,two,z@b.co"))
    row = headers.canonical_columns(raw, headers.REGISTRATION_HEADERS).first()
    assert (row.session_label, row.email) == ("two", "z@b.co")


def test_line_break_in_quotes_and_order_over_files(spark, tmp_path):
    write(tmp_path, "a.csv", "Email,Full Name", 'a@b.co,"Ada', 'Lovelace"')
    write(tmp_path, "b.csv", "Email,Full Name", "a@b.co,Later")
    rows, stats = sheets.parse_registrations(read_csv_strings(spark, str(tmp_path)))
    assert [r.full_name for r in rows.collect()] == ["Later"]
    assert stats.first().rows_read == 2


def test_session_workbook(spark, tmp_path):
    header = "Team Name,Leader Email,Leader Name,Team Size,Total Score (Latest Attempt)"
    for name, lines in {
        "Warm Up Challenge": ["Team A,a@b.co,Al,3,88.5"],
        "2.Main Challenge Submission": ["Same,x@b.co,X,2,1", " same ,y@b.co,Y,2,99", ",z@b.co,Z,1,5", 'Team B,b@b.co,Bo,"1,0",100'],
    }.items():
        write(tmp_path, f"{name}.csv", header, *lines)
    raw = read_csv_strings(spark, str(tmp_path)).withColumn("tab", F.regexp_replace(F.url_decode("_file"), r"\.csv$", ""))
    routed, errors = tabs.route_tabs_to_kind(raw, "tab")
    assert errors.count() == 0
    valid, counts = sheets.parse_submissions(routed, keep=["sheet_kind", "_ordinal"], kind="session")
    last = sheets.dedupe_submissions(valid, ["sheet_kind"], "team_name")
    got = {(r.sheet_kind, r.team_name, r.total_score, r.team_size) for r in last.collect()}
    assert got == {("warmup", "Team A", 88.5, 3), ("main", "same", 99.0, 2), ("main", "Team B", 100.0, 10)}


def test_duplicate_and_unknown_tabs_are_errors(spark, rows):
    names = spark.createDataFrame([("Main Challenge",), ("Challenge 2 Submission",), ("Extra",), ("Warm up challenge",)], "tab string")
    ok, bad = tabs.route_tabs_to_kind(names, "tab")
    assert rows(ok) == [("Warm up challenge", "warmup")]
    assert {r.reason for r in bad.collect()} == {"several tabs of this kind", "unknown tab"}


def test_round_tabs(spark):
    rounds = spark.createDataFrame(
        [(1, "Challenge 1", None), (2, "Anything", " FOO "), (3, "Bar", ""), (4, "x", "dup"), (5, "Dup", None)],
        "id int, title string, import_sheet_suffix string",
    )
    names = ["1.Submission Challenge 1", "2)Submission Foo", "Summary", "Submission none", "submission  bar", "Submission dup"]
    ok, bad = tabs.route_tabs_to_rounds(spark.createDataFrame([(n,) for n in names], "tab string"), "tab", rounds)
    assert {(r.tab, r.challenge_id) for r in ok.collect()} == {(names[0], 1), (names[1], 2), (names[4], 3)}
    assert {r.tab: r.reason for r in bad.collect()} == {
        "Summary": "not a submission tab", "Submission none": "no round matches",
        "Submission dup": "several rounds share this key",
    }
    assert tabs.colliding_keys(rounds).first().key == "dup"


def test_attempts_sheet_and_mapping(spark, tmp_path):
    raw = read_csv_strings(spark, write(tmp_path, "t.csv", "Work Email,Qta", "x@y.com,2", "bad,3", "z@y.com,0", "w@y.com,\"1,000\""))
    mapped = headers.apply_mapping(raw, {"leader_email": "Work Email", "attempts_completed": "Qta"},
                                   ["leader_email", "attempts_completed"])
    got = {(r.leader_email, r.attempts_completed) for r in sheets.parse_attempts(mapped).collect()}
    assert got == {("x@y.com", 2), ("w@y.com", 1000)}
    with pytest.raises(ValueError):
        headers.apply_mapping(raw, {"leader_email": "Work Email"}, ["leader_email", "attempts_completed"])
    with pytest.raises(ValueError):
        headers.apply_mapping(raw, {"leader_email": "Nope", "attempts_completed": "Qta"}, ["leader_email"])


def test_email_list(spark, rows):
    cells = spark.createDataFrame([("a@example.com",), ("A@example.com ",), ("b@example.com",), (" ",), (None,), ("not-an-email",)], "m string")
    emails, stats = email_list(cells, "m")
    assert rows(emails) == [("a@example.com",), ("b@example.com",)]
    assert tuple(stats.first()) == (6, 2, 1, 2)


def test_bootcamp_rows(spark, tmp_path):
    raw = read_csv_strings(spark, write(
        tmp_path, "b.csv", "City,Date,Slot,F&B,Capacity,Attendees,Activation,Students,Professionals",
        "mumbai,2026-05-12,morning,tea,200,120,80,60,60", ",1970-01-01,noon,,-1,x,,,",
    ))
    typed = sheets.parse_bootcamp(raw)
    ok, bad = validate_rows(typed, bootcamp_rules())
    row = ok.first()
    assert (row.city, row.bootcamp_on, row.capacity, row.activations, row.food_beverage) == (
        "mumbai", date(2026, 5, 12), 200, 80, "tea")
    assert bad.first().errors == [
        "city is required", "bootcamp_on must be a valid date", "slot must be morning or evening", "capacity must be >= 0"]


def test_leader_source_first_row_wins(spark, rows):
    df = spark.createDataFrame([(1, "A@b.co", "Ann", "1"), (2, "a@b.co", "Bob", "2"), (3, " ", "C", "3")],
                               "n int, leader_email string, leader_name string, leader_phone string")
    assert rows(sheets.leader_sources(df, ["n"])) == [("a@b.co", "A@b.co", "Ann", "1")]


@pytest.mark.parametrize(
    "payload, expected",
    [
        ([{"email": "a"}, 3], ["a"]),
        ({"data": [{"email": "a"}, {"email": "b"}]}, ["a", "b"]),
        ({"event": {"registrations": [{"email": "a"}]}}, ["a"]),
        ({"result": {"rows": [["email", "n"], ["a", 1], ["b"]]}}, ["a", "b"]),
        ({"columns": ["email", "n"], "data": [["a", 1], ["b", 2]]}, ["a", "b"]),
        ({"data": [["email"], ["a"]]}, ["a"]),
        ({"items": [], "users": [{"email": "a"}]}, ["a"]),
        ({"data": {"headers": ["email"], "items": [["a"]]}}, ["a"]),
        ({"data": []}, []),
        ([], []),
        ({"message": "none"}, None),
        ([1, 2], None),
        ("not json", None),
    ],
)
def test_payload_shapes(spark, payload, expected):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    records, unknown = payloads.extract_records_json(spark.createDataFrame([(1, text)], "k int, p string"), "p")
    got = [r.record["email"] for r in records.orderBy("record_no").collect()]
    assert got == (expected or [])
    assert unknown.count() == (1 if expected is None else 0)


def test_registration_records(spark):
    records = [
        {"E-Mail": "  User@Example.com  ", "Full Name": "U", "created_at": "2026-04-24T15:06:27+05:30", "DOB": "1970-01-01",
         "Designation": "Dev ( 3 )", "phone": "1", "In which city, would you like to attend the final?": "Pune"},
        {"full_name": "Nobody"},
        {"email": " ", "user_email": "second@x.co", "name": "", "participant-name": "P"},
    ]
    df = spark.createDataFrame([(1, json.dumps(records))], "k int, p string")
    rows, rejects = payloads.map_registration_records(payloads.extract_records_json(df, "p")[0])
    got = {r.email: r for r in rows.collect()}
    first = got["User@Example.com"]
    assert (first.full_name, first.designation, first.designation_years, first.mobile, first.dob, first.attendance_city) == (
        "U", "Dev", 3, "1", None, "Pune")
    assert first.form_timestamp == datetime(2026, 4, 24, 9, 36, 27)
    assert got["second@x.co"].full_name == "P"
    assert [r.reason for r in rejects.collect()] == ["missing email"]


def test_rsvp_snapshot(spark):
    payload = {"event": {"eventTag": "t", "eventName": "n"}, "stats": {"rsvpInviteSent": 4, "rsvpAccepted": 3, "checkedInParticipants": 3},
               "statsEmails": {"rsvpAccepted": ["a@b.co"]}}
    row = payloads.parse_rsvp_snapshot(spark.createDataFrame([(1, json.dumps(payload))], "id int, p string"), "p").first()
    assert (row.rsvp_invite_sent, row.rsvp_accepted, row.checked_in_participants, row.external_event_tag) == (4, 3, 3, "t")
    assert row.stats_emails == {"rsvpAccepted": ["a@b.co"]}


def test_file_manifest(spark, tmp_path):
    for name, lines in (("a.csv", ["k", "1", "2", ""]), ("b.csv", ["k", "2", "1"]), ("c.csv", ["k", "2", "2"])):
        write(tmp_path, name, *lines)
    listed = file_manifest(read_csv_strings(spark, str(tmp_path)), "registrations", ["k"])
    got = {r.file_name: r for r in with_status(listed, spark.createDataFrame([("b.csv", "loaded")], "file_name string, status string")).collect()}
    assert {k: (r.n_rows, r.status) for k, r in got.items()} == {"a.csv": (2, "received"), "b.csv": (2, "loaded"), "c.csv": (2, "received")}
    assert got["a.csv"].digest == got["b.csv"].digest != got["c.csv"].digest and got["b.csv"].size_bytes == 6


def test_manifest_lists_empty_files_and_sizes(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")}
    listed = whole_manifest(spark.read.parquet(str(tmp_path / "t")), listed_files(spark, str(tmp_path / "t")), "tables")
    got = {r.file_name: r for r in listed.collect()}
    assert len(sizes) == 2 and {k: r.size_bytes for k, r in got.items()} == sizes
    assert sorted((r.n_rows, r.digest != 0) for r in got.values()) == [(0, False), (1, True)]


CSV_CELLS = ["", "plain", 'say "hi"', "two\nlines", "\n", '"', '""', ",", 'a,"b\n",c', "blank\n\nline", "x" * 90, 'end"\n"', "Zoë\n\n\n,\"", "cr\r\nlf"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [50, 1 << 20])
def test_records_with_breaks_are_split_at_any_line(spark, tmp_path, ending, split):
    import csv
    import random

    rng, expected = random.Random(split), []
    for name, n in (("a", 60), ("b", 25), ("c", 0)):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=ending)
            out.writerow(["Key", "First\nhalf", "Key"])
            for i in range(n):
                row = [f"{name}{i}", rng.choice(CSV_CELLS), rng.choice(CSV_CELLS)]
                out.writerow(row)
                expected.append((f"{name}.csv", *row))
                if i % 9 == 0:
                    f.write(ending)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = read_csv_records(spark, str(tmp_path))
        rows = read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert read.columns == ["Key", "First\nhalf", "Key\t2", "_ordinal", "_file"]
    got = [(r["_file"], r[0], r[1] or "", r[2] or "") for r in sorted(rows, key=lambda r: tuple(r["_ordinal"]))]
    assert got == expected
    if split == 50:
        assert len({(r["_ordinal"].file, r["_ordinal"].block) for r in rows}) > 20


def test_quotes_inside_bare_cells_do_not_open(spark, tmp_path):
    path = write(tmp_path, "q.csv", "a,b", '5" disc,1', 'x,"y', 'z"', "", '6" disc,"2"')
    assert [tuple(r)[:2] for r in sorted(read_csv_records(spark, path).collect(), key=lambda r: r["_ordinal"])] == [
        ('5" disc', "1"), ("x", "y\nz"), ('6" disc', "2")]


def test_a_table_without_records_has_no_rows(spark, tmp_path):
    read = read_csv_records(spark, write(tmp_path, "e.csv", "a,b"))
    assert read.columns[:2] == ["a", "b"] and read.count() == 0


def test_heavy_work_is_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    from turnout.sources import files

    monkeypatch.setattr(files, "TASK_ROWS", 100)
    monkeypatch.setattr(files, "TASK_BYTES", 1000)
    dealt = files.spread(spark.range(0, 5000, 1, 8))
    assert dealt.rdd.getNumPartitions() == 50 and max(dealt.rdd.glom().map(len).collect()) <= 110
    long = spark.range(0, 50, 1, 8).select(F.repeat(F.lit("x"), 1000).alias("p"))
    assert files.spread(long, "p").rdd.getNumPartitions() == 50


def test_rejects_and_unknown_payloads_take_one_parse(spark):
    rows = [(1, '[{"name": "a"}, {"email": "a@x.co"}]'), (2, '{"note": 1}'), (3, "{"), (4, None)]
    records, unknown = payloads.extract_records_json(spark.createDataFrame(rows, "k int, p string"), "p", both=True)
    _, rejects = payloads.map_registration_records(records)
    both = rejects.select("k", "reason").unionByName(unknown.select("k", F.lit("no records").alias("reason")))
    assert {tuple(r) for r in both.collect()} == {(1, "missing email"), (2, "no records"), (3, "no records"), (4, "no records")}
    assert "parse_json" not in both._jdf.queryExecution().executedPlan().toString()


def test_lines_of_records_are_not_shuffled(spark, tmp_path):
    """Only parts of records that span splits move; all lines did, several times."""
    from turnout.sources import files

    write(tmp_path, "a.csv", "a,b", *(f'{i},"x\ny ""z""\n"' for i in range(500)))
    lines = files._placed(files.pinned(files._line_states(spark.read.option("lineSep", "\n").text(str(tmp_path)))))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and read_csv_records(spark, str(tmp_path)).select("a", "b").distinct().count() == 500
    moved = [n for n in files._records(lines)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in n and "Broadcast" not in n]
    assert not any("hashpartitioning(file" in n and "block" in n and "number" not in n and "value" in n for n in moved)
