"""Activity and change log search, and the history of one record."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import month_of
from turnout.functions.text import as_col
from turnout.operators.ordering import ranked_page
from turnout.operators.roster import text_search

ACTIVITY_TEXT = (
    "action", "endpoint", "url", "principal", "principal_email", "request_id", "sql_kind", "sql_statement", "module",
    "entity", "user_agent", "source", "extra",
)
CHANGE_TEXT = (
    "table_name", "schema_name", "op", "principal", "principal_email", "request_id", "source", "record_pk",
    "changed_columns", "changes", "statement_tag",
)


def window_hours(raw: str | None) -> int | None:
    """Hours to look back: 168 by default, None (all time) for zero or less."""
    try:
        hours = int((raw or "").strip() or 168)
    except ValueError:
        return 168
    return None if hours <= 0 else hours


def since(as_of: datetime, hours: int | None) -> Column | None:
    if hours is None:
        return None
    return F.lit((as_of - timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _since(log: DataFrame, start: Column | None) -> DataFrame:
    if start is None:
        return log
    if "month" in log.columns:
        log = log.where(F.col("month") >= month_of(start))
    return log.where(F.col("occurred_at") >= start)


def activity_search(log: DataFrame, q: str = "", action: str = "", start: Column | None = None) -> DataFrame:
    """Matching activity rows; text is looked for in every text column the log has.

    A log partitioned by ``month`` is read from the month of ``start`` on.
    """
    out = _since(log, start)
    if action:
        out = out.where(F.col("action") == action)
    if q:
        out = out.where(text_search([c for c in ACTIVITY_TEXT if c in log.columns], q))
    return out


def change_search(log: DataFrame, q: str = "", start: Column | None = None) -> DataFrame:
    """Matching change rows; arrays and maps are searched as JSON text."""
    out = _since(log, start)
    if not q:
        return out
    found = F.lit(False)
    for f in log.schema:
        if f.name in CHANGE_TEXT:
            nested = f.dataType.typeName() in ("array", "map", "struct")
            text = F.to_json(f.name) if nested else F.col(f.name).cast("string")
            found = found | F.coalesce(text, F.lit("")).ilike(f"%{q}%")
    return out.where(found)


def log_page(rows: DataFrame, tie: str, page: int = 1, per_page: int = 50) -> DataFrame:
    """One page, newest first."""
    order = [F.desc("occurred_at"), F.desc(tie)]
    return ranked_page(rows, order, per_page, max(page - 1, 0) * per_page, name="row")


def distinct_actions(log: DataFrame, start: Column | None = None, cap: int | None = None) -> DataFrame:
    actions = _since(log, start).select("action").where("action IS NOT NULL AND action <> ''").distinct().orderBy("action")
    return actions if cap is None else actions.limit(cap)


def has_pk(record_pk: Column | str, row_id: int | str) -> Column:
    """The JSON key object holds this id."""
    return F.get_json_object(as_col(record_pk), "$.id") == str(row_id)


def record_timeline(
    changes: DataFrame, views: DataFrame, table_name: str, entity: str, module: str, row_id: int,
    change_cap: int | None = None, view_cap: int | None = None, cap: int | None = None,
) -> DataFrame:
    """Changes and views of one record in time order; caps, where given, keep the earliest of each list and of all."""
    first = lambda rows, n: rows if n is None else rows.limit(n)
    columns = F.array_join("changed_columns", ", ")
    data = (
        first(changes.where((F.col("table_name") == table_name) & has_pk("record_pk", row_id)).orderBy("occurred_at", "op"), change_cap)
        .select(
            "occurred_at", F.lit("data").alias("kind"), "op",
            F.when(F.col("op") == "INSERT", "Registration row inserted")
            .when(F.col("op") == "UPDATE", F.concat(F.lit("Updated: "), F.coalesce(columns, F.lit("(no column list)"))))
            .when(F.col("op") == "DELETE", "Registration row deleted")
            .otherwise(F.col("op")).alias("summary"),
            "principal",
        )
    )
    seen = (
        first(views.where(
            (F.col("action") == "VIEW") & (F.coalesce("entity", F.lit("")) == entity)
            & (F.coalesce("module", F.lit("")) == module) & has_pk("record_pk", row_id)
        ).orderBy("occurred_at", "endpoint"), view_cap)
        .select(
            "occurred_at", F.lit("event").alias("kind"), F.col("action").alias("op"),
            F.concat(F.lit("Detail viewed"), F.when(F.coalesce("endpoint", F.lit("")) != "",
                     F.concat(F.lit(" — "), F.col("endpoint"))).otherwise("")).alias("summary"),
            "principal",
        )
    )
    return first(data.unionByName(seen).orderBy("occurred_at", "kind", "summary"), cap)
