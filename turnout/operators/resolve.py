"""Row validation, reference resolution and scope checks, each with its rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.classify import valid_email
from turnout.functions.dates import SENTINEL_DATE
from turnout.functions.text import slot_name, strip_all
from turnout.operators.dedupe import keep_first
from turnout.operators.merge import null_safe


def validate_rows(df: DataFrame, rules: Mapping[str, Column], index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows by ``rules`` (message to failing condition): accepted, and rejected with ``errors``.

    With ``index``, a column that numbers the rows, each message names its row.
    """
    where = F.lit("") if index is None else F.concat(F.lit("row "), F.col(index).cast("string"), F.lit(": "))
    errors = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.concat(where, F.lit(message))) for message, bad in rules.items()])
    )
    checked = df.withColumn("errors", errors)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


#: Count columns of a bootcamp session.
SESSION_COUNTS = ("audience_size", "capacity", "attendees", "activations", "students", "professionals")


def bootcamp_rules(counts: Sequence[str] = SESSION_COUNTS) -> dict[str, Column]:
    """Rules for bootcamp session rows: city, real date, known slot, non-negative counts."""
    rules = {
        "city is required": F.coalesce(strip_all("city"), F.lit("")) == "",
        "bootcamp_on must be a valid date": F.col("bootcamp_on").isNull(),
        "1970-01-01 is not a valid session date": F.col("bootcamp_on").eqNullSafe(F.lit(SENTINEL_DATE)),
        "slot must be morning or evening": slot_name("slot").isNull(),
    }
    for c in counts:
        rules[f"{c} must be >= 0"] = F.coalesce(F.col(c), F.lit(0)) < 0
    return rules


def session_date_rules(on: str, label: str) -> dict[str, Column]:
    """A session label needs a date, and the sentinel is not one."""
    blank = F.coalesce(strip_all(label), F.lit("")) == ""
    return {
        "1970-01-01 is not a valid session date": F.col(on).eqNullSafe(F.lit(SENTINEL_DATE)),
        "session date is required when a label is set": F.col(on).isNull() & ~blank,
    }


def email_list(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Distinct valid addresses, and one row of counts (read, blank, invalid, kept)."""
    cell = F.col(column)
    blank = cell.isNull() | (strip_all(cell) == "")
    address = valid_email(cell)
    emails = df.select(address.alias("email")).where("email IS NOT NULL").distinct()
    stats = df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(blank).alias("rows_blank_email"),
        F.count_if(~blank & address.isNull()).alias("rows_invalid_email"),
        F.count_distinct(address).alias("rows_after_dedupe"),
    )
    return emails, stats


def missing_references(df: DataFrame, ref: DataFrame, key: str, ref_key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``ref`` lacks."""
    wanted = df.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).distinct()
    have = ref.select(F.col(ref_key).alias("_have")).distinct()
    return wanted.join(have, F.col(key) == F.col("_have"), "left_anti")


def resolve_required(
    df: DataFrame, ref: DataFrame, key: str, ref_key: str, policy: str, source: Mapping[str, str] | None = None,
    order: Sequence[str] = (), defaults: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gate on a required reference: (rows, missing keys, reference rows to create).

    ``error`` raises when a key is missing, ``skip`` drops those rows, ``create`` keeps them and
    derives a minimal reference row from the first row of each missing key (``source`` maps
    reference columns to ``df`` columns).
    """
    missing = missing_references(df, ref, key, ref_key)
    nothing = ref.limit(0)
    if policy == "error":
        if not missing.isEmpty():
            raise ValueError(f"{key}: references are missing")
        return df, missing, nothing
    absent = missing.select(F.col(key).alias("_absent"))
    if policy == "skip":
        kept = df.join(absent, F.col(key) == F.col("_absent"), "left_anti").where(F.col(key).isNotNull())
        return kept, missing, nothing
    if policy != "create":
        raise ValueError(f"unknown policy: {policy!r}")
    columns = {ref_key: key, **(source or {})}
    used = list(dict.fromkeys([*columns.values(), *order]))
    rows = df.join(absent, F.col(key) == F.col("_absent"), "left_semi").select(*used)
    first = keep_first(rows, [key], order or [c for c in used if c != key] or [key])
    filled = [
        (F.col(columns[f.name]) if f.name in columns else (defaults or {}).get(f.name, F.lit(None)))
        .cast(f.dataType).alias(f.name)
        for f in ref.schema
    ]
    return df, missing, first.select(*filled)


def best_match(
    regs: DataFrame, email: str, row_id: str, on: str, label: str, session_on: Column, session_label: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One registration per e-mail for a session: same session, else undated, else any; lowest id first."""
    own = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    wanted = F.lower(F.trim(session_label))
    rank = (
        F.when(F.col(on).eqNullSafe(session_on) & (own == wanted), 0)
        .when(F.col(on).isNull() & (own == ""), 1)
        .otherwise(2)
    )
    return keep_first(
        regs.select(email, row_id, *carry, rank.alias("match_rank")), [email], ["match_rank", row_id]
    )


def scope_gate(
    batch: DataFrame, scopes: DataFrame, key: str, must_equal: Mapping[str, str], reason: str = "reason"
) -> tuple[DataFrame, DataFrame]:
    """Keep rows whose scope exists and agrees on every column of ``must_equal``; the rest get a reason.

    Where ``scopes`` repeats a key, a row must agree with one of its rows.
    """
    side = scopes.groupBy(F.col(key).alias("_scope")).agg(F.collect_set(F.struct(*must_equal.values())).alias("_known"))
    joined = batch.join(side, F.col(key) == F.col("_scope"), "left")

    def agrees(columns: Mapping[str, str]) -> Column:
        def row(known: Column) -> Column:
            same = F.lit(True)
            for b, d in columns.items():
                same = same & F.col(b).eqNullSafe(known[d])
            return same
        return F.exists("_known", row)

    why = F.when(F.col("_scope").isNull(), F.lit("scope not found"))
    for b, d in must_equal.items():
        why = why.when(~agrees({b: d}), F.lit(f"{b} does not match scope"))
    why = why.when(~agrees(must_equal), F.lit("no scope matches as a whole"))
    checked = joined.withColumn(reason, why).drop("_scope", "_known")
    return checked.where(F.col(reason).isNull()).drop(reason), checked.where(F.col(reason).isNotNull())


def kind_gate(df: DataFrame, programmes: DataFrame, kind: str, event_id: str = "event_id") -> DataFrame:
    """Rows whose programme has the given kind."""
    ok = programmes.where(F.col("kind") == kind).select(F.col("id").alias("_programme"))
    return df.join(ok, F.col(event_id) == F.col("_programme"), "left_semi")


def natural_key_fallback(
    facts: DataFrame, sessions: DataFrame, fk: str, dim_id: str, on: Mapping[str, str], carry: Sequence[str]
) -> DataFrame:
    """Attach session columns by id, or by natural key where the id is empty."""
    by_id = sessions.select(F.col(dim_id).alias("_sid"), *carry)
    linked = facts.where(F.col(fk).isNotNull()).join(by_id, F.col(fk) == F.col("_sid"), "left").drop("_sid")
    # Of sessions with one natural key the smallest id counts.
    side = keep_first(sessions, list(on.values()), [dim_id]).select(*[F.col(d).alias(f"_d{i}") for i, d in enumerate(on.values())], *carry)
    match = F.lit(True)
    for i, f in enumerate(on):
        match = match & (F.col(f) == F.col(f"_d{i}"))
    loose = facts.where(F.col(fk).isNull()).join(side, match, "left").drop(*[f"_d{i}" for i in range(len(on))])
    return linked.unionByName(loose)


def pair_stats(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct pairs in each of two row sets, in both, and in the first only."""
    tagged = a.select(*keys, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionByName(
        b.select(*keys, F.lit(False).alias("_a"), F.lit(True).alias("_b"))
    )
    flags = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return flags.agg(
        F.count_if("_a").alias("n_a"),
        F.count_if("_b").alias("n_b"),
        F.count_if(F.col("_a") & F.col("_b")).alias("converted"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("a_only"),
        F.count_if(F.col("_b") & ~F.col("_a")).alias("b_only"),
    )


__all__ = [
    "bootcamp_rules", "best_match", "email_list", "kind_gate", "missing_references", "natural_key_fallback",
    "null_safe", "pair_stats", "resolve_required", "scope_gate", "session_date_rules", "validate_rows",
]
