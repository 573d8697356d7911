"""Duplicate removal and latest-row selection.

Both are aggregations with map-side combine, not windows: copies of one key collapse
before the shuffle, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], chooser, order: Sequence[Column | str]) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), position).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    return _pick(df, keys, F.max_by, order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return _pick(df, keys, F.min_by, order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Latest snapshot per key: greatest (time, id)."""
    return keep_last(df, keys, order)


def dedupe_stats(df: DataFrame, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """One row: rows read, rows lacking a required value, rows kept, rows collapsed."""
    usable = F.lit(True)
    for c in required:
        usable = usable & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    # Counting per key first keeps the distinct count one combinable aggregation.
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(F.when(usable, 1)).alias("_usable")
    )
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_usable")), F.lit(0)).alias("rows_skipped"),
        F.count(F.when(F.col("_usable") > 0, 1)).alias("rows_after_dedupe"),
        F.coalesce(F.sum(F.greatest(F.col("_usable") - 1, F.lit(0))), F.lit(0)).alias("rows_collapsed"),
    )


def keep_latest_and_repoint(
    table: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    row_id: str,
    children: Sequence[tuple[DataFrame, str]] = (),
) -> tuple[DataFrame, list[DataFrame]]:
    """Keep the newest row per key; point foreign keys of dropped rows at the keeper."""
    kept = keep_last(table, keys, order)
    keeper = kept.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(row_id).alias("_keeper"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    moved = (
        table.select(row_id, *keys)
        .join(keeper, match)
        .where(F.col(row_id) != F.col("_keeper"))
        .select(F.col(row_id).alias("_old_id"), "_keeper")
    )
    out = []
    for child, fk in children:
        out.append(
            child.join(moved, F.col(fk) == F.col("_old_id"), "left")
            .withColumn(fk, F.coalesce("_keeper", fk))
            .drop("_old_id", "_keeper")
        )
    return kept, out
