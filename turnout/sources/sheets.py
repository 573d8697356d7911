"""Typed rows from registration, submission, attempt, bootcamp and e-mail sheets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import parse_date_text, parse_timestamp_text
from turnout.functions.numbers import attempts_from_text, float_from_text, int_from_text
from turnout.functions.text import blank_to_null, session_label, split_trailing_years, strip_all
from turnout.operators.dedupe import dedupe_stats, keep_first, keep_last
from turnout.sources.files import ORDINAL
from turnout.sources.headers import (
    BOOTCAMP_HEADERS,
    REGISTRATION_HEADERS,
    ROUND_HEADERS,
    SESSION_HEADERS,
    canonical_columns,
)


def type_registrations(cells: DataFrame) -> DataFrame:
    """Typed registration rows from text cells; rows without an e-mail keep a NULL one."""
    designation, years = split_trailing_years("designation")
    special = {
        "form_timestamp": parse_timestamp_text("form_timestamp"),
        "dob": parse_date_text("dob"),
        "session_on": parse_date_text("session_on"),
        "session_label": session_label("session_label"),
        "designation": designation,
    }
    carried = [c for c in cells.columns if c.startswith("_")]
    columns = [special.get(c, blank_to_null(c)).alias(c) for c in cells.columns if c not in carried]
    return cells.select(*columns, years.alias("designation_years"), *carried)


def parse_registrations(
    raw: DataFrame, programmes: Iterable[str] = (), order: Sequence[str] = (ORDINAL,)
) -> tuple[DataFrame, DataFrame]:
    """Registration file rows: last one per (e-mail, session), and one row of counts."""
    cells = canonical_columns(
        raw, REGISTRATION_HEADERS, required=["email"], programmes=programmes, also=["attendance_city"]
    )
    typed = type_registrations(cells)
    keys = ["email", "session_on", "session_label"]
    rows = keep_last(typed.where("email IS NOT NULL"), keys, order)
    return rows, dedupe_stats(typed, keys, required=["email"])


def type_submissions(cells: DataFrame) -> DataFrame:
    special = {
        "team_size": int_from_text("team_size"),
        "attempts_completed": int_from_text("attempts_completed"),
        "total_score": float_from_text("total_score"),
        "export_created_at": parse_timestamp_text("export_created_at", "UTC"),
        "export_updated_at": parse_timestamp_text("export_updated_at", "UTC"),
    }
    sheet = {*ROUND_HEADERS.values(), *SESSION_HEADERS.values()}
    return cells.select(
        *[(special.get(c, blank_to_null(c)).alias(c) if c in sheet else F.col(c)) for c in cells.columns]
    )


def parse_submissions(raw: DataFrame, keep: Sequence[str], kind: str = "round") -> tuple[DataFrame, DataFrame]:
    """Submission rows with team and leader e-mail; ``keep`` columns (the routing) pass through.

    Also the rows per ``keep`` group that were read and that were valid.
    """
    names = ROUND_HEADERS if kind == "round" else SESSION_HEADERS
    key = [c for c in keep if c in raw.columns]
    held = raw.withColumn("_file", F.struct(*key)) if key else raw
    cells = canonical_columns(held, names, required=["team_name", "leader_email"])
    if key:
        own = [c for c in cells.columns if c != "_file" and c not in key]
        cells = cells.select(*own, *[F.col("_file")[k].alias(k) for k in key])
    typed = type_submissions(cells)
    valid = F.col("team_name").isNotNull() & F.col("leader_email").isNotNull()
    groups = [k for k in key if k != ORDINAL]
    counts = typed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count(F.when(valid, 1)).alias("rows_valid")
    )
    return typed.where(valid), counts


def dedupe_submissions(rows: DataFrame, scope: Sequence[str], member: str = "leader_email",
                       order: Sequence[str] = (ORDINAL,)) -> DataFrame:
    """Last row per scope and normalised member (leader e-mail of a round, team name of a session)."""
    keyed = rows.withColumn("_member", F.lower(strip_all(member)))
    return keep_last(keyed, [*scope, "_member"], order).drop("_member")


def parse_attempts(mapped: DataFrame) -> DataFrame:
    """(leader_email, attempts_completed) with an address and at least one attempt."""
    email = blank_to_null("leader_email")
    n = attempts_from_text("attempts_completed")
    return mapped.withColumns({"leader_email": email, "attempts_completed": n}).where(
        F.col("leader_email").contains("@") & F.col("attempts_completed").isNotNull()
    )


_BOOTCAMP_COUNTS = ("audience_size", "capacity", "attendees", "activations", "students", "professionals")


def parse_bootcamp(raw: DataFrame) -> DataFrame:
    """Bootcamp session rows: text empty when blank, counts zero when blank or not numeric."""
    cells = canonical_columns(raw, BOOTCAMP_HEADERS, required=["city", "bootcamp_on", "slot"])
    out = []
    for c in cells.columns:
        if c in _BOOTCAMP_COUNTS:
            out.append(F.coalesce(int_from_text(c), F.lit(0)).alias(c))
        elif c == "bootcamp_on":
            out.append(parse_date_text(c).alias(c))
        elif c.startswith("_"):
            out.append(F.col(c))
        else:
            out.append(F.coalesce(strip_all(c), F.lit("")).alias(c))
    return cells.select(*out)


def leader_sources(rows: DataFrame, order: Sequence[str] = (ORDINAL,)) -> DataFrame:
    """First row per normalised leader e-mail: address as written, name, phone."""
    used = rows.select(
        F.lower(strip_all("leader_email")).alias("email_normalized"),
        strip_all("leader_email").alias("leader_email"),
        "leader_name",
        "leader_phone",
        *order,
    ).where("email_normalized <> ''")
    return keep_first(used, ["email_normalized"], order).drop(*order)
