"""Set-based writes: upserts, patches, slices, links and idempotent appends.

Each takes the current rows and the incoming rows and returns the new rows; the caller
writes them to a new location or partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators.dedupe import keep_first, keep_last


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    match = F.lit(True)
    for a, b in zip(left, right):
        match = match & F.col(a).eqNullSafe(F.col(b))
    return match


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    keep_if_null: Sequence[str] = (),
    additive: Sequence[str] = (),
    insert_only: bool = False,
    touch: Mapping[str, Column] | None = None,
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """Merged rows plus ``_action`` (insert, update or keep).

    Incoming rows replace current ones, except that ``keep_if_null`` columns keep the current
    value where the incoming one is NULL and ``additive`` columns are summed.  ``touch`` sets
    columns of inserted and updated rows, such as the update time.  Keys match NULL to NULL.
    Of incoming rows with one key the last by ``order`` counts; without an order a repeated key is an error.
    """
    keys = list(keys)
    body = [c for c in current.columns if c not in keys]
    old = current.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(F.lit(1).alias("_"), *body).alias("_old"))
    new_body = [c for c in body if c in incoming.columns]
    row = F.struct(F.lit(1).alias("_"), *new_body)
    if order:
        new = keep_last(incoming, keys, order).select(*[F.col(k).alias(f"_n_{k}") for k in keys], row.alias("_new"))
    else:
        new = incoming.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(F.any_value(row).alias("_new"), F.count(F.lit(1)).alias("_k"))
        new = new.withColumn("_new", F.when(F.col("_k") == 1, F.col("_new")).otherwise(
            F.raise_error(F.lit("incoming rows repeat a key: give an order")))).drop("_k")
    both = old.join(new, null_safe([f"_o_{k}" for k in keys], [f"_n_{k}" for k in keys]), "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    written = has_new & ~has_old if insert_only else has_new

    def merged(c: str) -> Column:
        was = F.col("_old")[c]
        if c in (touch or {}):
            return F.when(written, touch[c]).otherwise(was)
        if c not in new_body:
            return was
        now = F.col("_new")[c]
        if insert_only:
            return F.when(has_old, was).otherwise(now)
        if c in additive:
            total = F.coalesce(was, F.lit(0)) + F.coalesce(now, F.lit(0))
            return F.when(has_new & has_old, total.cast(current.schema[c].dataType)).when(has_new, now).otherwise(was)
        if c in keep_if_null:
            return F.coalesce(now, was)
        return F.when(has_new, now).otherwise(was)

    action = F.when(written & has_old, "update").when(written, "insert").otherwise("keep")
    out = {k: F.when(has_old, F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}")) for k in keys}
    out.update({c: merged(c).cast(current.schema[c].dataType) for c in body})
    return both.select(*[out[c].alias(c) for c in current.columns], action.alias("_action"))


def count_actions(merged: DataFrame) -> DataFrame:
    return merged.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows plus the incoming rows whose key is new; first incoming row wins."""
    fresh = keep_first(incoming, keys, order)
    have = current.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).distinct()
    fresh = fresh.join(have, null_safe(keys, [f"_h_{k}" for k in keys]), "left_anti")
    return current.unionByName(fresh.select(*current.columns))


def append_idempotent(history: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` to append: one per idempotency key, none already in ``history``.

    Rows without a key are never duplicates of each other.
    """
    keyed = keep_first(batch.where(F.col(key).isNotNull()), [key], order)
    seen = history.where(F.col(key).isNotNull()).select(F.col(key).alias("_seen")).distinct()
    keyed = keyed.join(seen, F.col(key) == F.col("_seen"), "left_anti")
    return keyed.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))


def replace_slice(
    current: DataFrame, incoming: DataFrame, slice_keys: Sequence[str], slices: DataFrame | None = None
) -> DataFrame:
    """Drop the current rows of every replaced slice, then add the incoming rows.

    ``slices`` names the replaced slices when some of them become empty.
    """
    gone = (slices if slices is not None else incoming).select(*[F.col(k).alias(f"_g_{k}") for k in slice_keys])
    kept = current.join(gone.distinct(), null_safe(slice_keys, [f"_g_{k}" for k in slice_keys]), "left_anti")
    return kept.unionByName(incoming.select(*current.columns))


def patch_column(
    current: DataFrame,
    sheet: DataFrame,
    keys: Sequence[str],
    column: str,
    order: Sequence[str],
    scope: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Set ``column`` from the last sheet row per key, inside ``scope``; also the sheet rows without a match."""
    scope = F.lit(True) if scope is None else scope
    last = keep_last(sheet.select(*dict.fromkeys([*keys, column, *order])), keys, order)
    last = last.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(column).alias("_patch"))
    match = null_safe(keys, [f"_s_{k}" for k in keys]) & scope
    patched = (
        current.join(last, match, "left")
        .withColumn(column, F.coalesce(F.col("_patch"), F.col(column)).cast(current.schema[column].dataType))
        .drop("_patch", *[f"_s_{k}" for k in keys])
    )
    targets = current.where(scope).select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
    unmatched = sheet.join(targets, null_safe(keys, [f"_t_{k}" for k in keys]), "left_anti")
    return patched, unmatched


def unmatched_report(unmatched: DataFrame, key: str, sample: int) -> DataFrame:
    """Unmatched row count, distinct keys and the first ``sample`` keys in order."""
    per_key = unmatched.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    shown = per_key.where(F.col(key).isNotNull()).orderBy(key).limit(sample)
    names = shown.agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("s")).scalar()
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_not_matched"), F.count(key).alias("keys_not_matched")
    ).withColumn("sample", names)


def unlink_then_delete(
    dim: DataFrame, dim_id: str, gone: Column, facts: Mapping[str, tuple[DataFrame, str]]
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Delete dimension rows where ``gone``; NULL their foreign keys; count the unlinked rows per fact."""
    doomed = dim.where(gone).select(F.col(dim_id).alias("_gone")).distinct()
    unlinked, counts = {}, []
    for name, (fact, fk) in facts.items():
        marked = fact.join(doomed, F.col(fk) == F.col("_gone"), "left")
        unlinked[name] = marked.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone")
        counts.append(marked.agg(F.lit(name).alias("fact"), F.count("_gone").alias("n_unlinked")))
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return dim.where(~F.coalesce(gone, F.lit(False))), unlinked, report


def relink_by_natural_key(
    facts: DataFrame, dim: DataFrame, on: Mapping[str, str], fk: str, dim_id: str, lower: Sequence[str] = ()
) -> DataFrame:
    """Fill an empty foreign key from the dimension row with the same natural key.

    ``on`` maps fact columns to dimension columns; those in ``lower`` compare case-insensitively.  Of dimension rows with
    one key the smallest id counts.  Only facts with an empty key are joined.
    """
    def key(name: str, of: str) -> Column:
        return F.lower(F.trim(F.col(of))) if name in lower else F.col(of)

    side = dim.groupBy(*[key(f, d).alias(f"_d{i}") for i, (f, d) in enumerate(on.items())]).agg(F.min(dim_id).alias("_dim_id"))
    match = F.lit(True)
    for i, f in enumerate(on):
        match = match & (key(f, f) == F.col(f"_d{i}"))
    filled = (
        facts.where(F.col(fk).isNull()).join(side, match, "left").withColumn(fk, F.col("_dim_id"))
        .drop("_dim_id", *[f"_d{i}" for i in range(len(on))])
    )
    return facts.where(F.col(fk).isNotNull()).unionByName(filled)
