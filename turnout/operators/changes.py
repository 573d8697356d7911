"""Row-change capture between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators.merge import null_safe


def diff_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """INSERT / UPDATE / DELETE rows with the changed columns and their old and new values.

    Values are compared in their own type and reported as text; rows that did not change
    produce nothing.
    """
    keys = list(keys)
    body = [c for c in new.columns if c not in keys and c not in ignore]
    before = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*keys, *body).alias("_old"))
    after = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.struct(*keys, *body).alias("_new"))
    both = before.join(after, null_safe([f"_o_{k}" for k in keys], [f"_n_{k}" for k in keys]), "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def entry(c: str) -> Column:
        was, now = F.col("_old")[c], F.col("_new")[c]
        return F.when(
            ~was.eqNullSafe(now),
            F.struct(
                F.lit(c).alias("key"),
                F.struct(was.cast("string").alias("old"), now.cast("string").alias("new")).alias("value"),
            ),
        )

    entries = F.when(has_old & has_new, F.array_compact(F.array(*[entry(c) for c in body])))
    op = F.when(~has_old, "INSERT").when(~has_new, "DELETE").otherwise("UPDATE")
    pk = F.when(has_new, F.struct(*[F.col("_new")[k].alias(k) for k in keys])).otherwise(
        F.struct(*[F.col("_old")[k].alias(k) for k in keys])
    )
    return (
        both.withColumn("_entries", entries)
        .where(F.col("_entries").isNull() | (F.size("_entries") > 0))
        .select(
            op.alias("op"),
            F.to_json(pk).alias("record_pk"),
            F.transform("_entries", lambda e: e["key"]).alias("changed_columns"),
            F.map_from_entries("_entries").alias("changes"),
            F.to_json("_old").alias("old_row"),
            F.to_json("_new").alias("new_row"),
        )
    )


def with_context(
    changes: DataFrame, table_name: str, occurred_at: Column, principal: str = "system:db", source: str = "db",
    request_id: str | None = None,
) -> DataFrame:
    """Add the columns of the change log."""
    return changes.select(
        occurred_at.alias("occurred_at"),
        F.lit("public").alias("schema_name"),
        F.lit(table_name).alias("table_name"),
        "*",
        F.lit(principal).alias("principal"),
        F.lit(request_id).cast("string").alias("request_id"),
        F.lit(source).alias("source"),
    )
