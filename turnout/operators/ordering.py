"""Ranks, running totals and pages that do not pull the table into one task.

A window without PARTITION BY sorts everything in a single task.  Here the rows are range
partitioned on the whole sort key (so ties on the leading column are split by the next
one), each partition is numbered on its own, and a table with one row per partition
carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.session import durable

_PART = "_range_part"


def _ranged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range partition on ``order`` and pin the partition number of every row."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample, so a recomputation could move rows between
    # partitions after the offsets were counted: make the assignment durable first.
    return durable(df.repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    weight: Column,
    name: str,
    by: Sequence[str] = (),
    total_name: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` within each ``by`` group.

    ``order`` must be a total order.  ``total_name`` adds the sum over the whole group.
    """
    by = list(by)
    ranged = _ranged(df.withColumn("_w", weight), [*[F.col(b) for b in by], *order], partitions)
    sums = ranged.groupBy(*by, _PART).agg(F.sum("_w").alias("_part_sum"))
    # One row per partition (and per group inside it): a group spans at most all partitions.
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(b).alias(f"_o_{b}") for b in by],
        F.col(_PART).alias("_o_part"),
        F.coalesce(F.sum("_part_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_part_sum").over(group).alias("_total"),
    )
    match = F.col(_PART) == F.col("_o_part")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    local = Window.partitionBy(*by, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        ranged.join(offsets, match)
        .withColumn(name, F.col("_offset") + F.sum("_w").over(local))
    )
    if total_name:
        out = out.withColumn(total_name, F.col("_total"))
    return out.drop("_w", _PART, "_o_part", "_offset", "_total", *[f"_o_{b}" for b in by])


def bucketed_total(
    df: DataFrame, order: Sequence[Column], buckets: Sequence[Column], weight: Column, name: str, by: Sequence[str] = (),
    total_name: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` within each ``by`` group, without a job of its own.

    ``buckets`` go from coarse to fine.  None may decrease along ``order`` inside the bucket above it; they depend on the row alone, so nothing has to be
    pinned.  Rows are summed inside their finest bucket; what lies before it comes from one row a bucket, summed level by level inside the
    bucket above.  So a window holds one finest bucket's rows, or one coarser bucket's sums, and a hot range of values is spread over many tasks.
    """
    by, levels = list(by), [f"_b{i}" for i in range(len(buckets))]
    keyed = df.withColumns({**dict(zip(levels, buckets)), "_w": weight})
    sums, total = keyed, None
    for depth in range(len(levels), 0, -1):
        keys = [*by, *levels[:depth]]
        sums = sums.groupBy(*keys).agg(F.sum("_w" if depth == len(levels) else "_sum").alias("_sum"))
        upper = Window.partitionBy(*by, *levels[: depth - 1])
        earlier = upper.orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(f"_before{depth}"),
                             *([F.sum("_sum").over(upper).alias("_total")] if depth == 1 else []))
        if total is None:
            total = before
        else:
            match = F.lit(True)
            for k in keys:
                match = match & F.col(f"_o_{k}").eqNullSafe(F.col(f"_u_{k}"))
            # The level above has one row for many below; it joins their small table, not the rows.
            above = before.select(*[F.col(f"_o_{k}").alias(f"_u_{k}") for k in keys], f"_before{depth}", *(["_total"] if depth == 1 else []))
            total = total.join(above, match).drop(*[f"_u_{k}" for k in keys])
    match = F.lit(True)
    for k in [*by, *levels]:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    local = Window.partitionBy(*by, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = sum((F.col(f"_before{d}") for d in range(2, len(levels) + 1)), F.col("_before1"))
    out = keyed.join(total, match).withColumn(name, offset + F.sum("_w").over(local))
    if total_name:
        out = out.withColumn(total_name, F.col("_total"))
    return out.drop("_w", "_total", *levels, *[f"_before{d}" for d in range(1, len(levels) + 1)], *[f"_o_{k}" for k in [*by, *levels]])


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    ties: Sequence[str] | None = None,
    name: str = "rank",
    row_name: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number every row by the total order ``order``.

    With ``ties`` (the leading sort columns) equal rows share the rank of the first of them,
    as SQL ``RANK()`` does; ``row_name`` then also gives the plain row number.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The place within the sorted range partition is in the low 33 bits of the id, the partition above them.  It is
    # pinned before it is used, as a recomputation could draw other range bounds.
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = durable(placed).withColumn(_PART, F.shiftright("_id", 33))
    # One row per range partition, so the unpartitioned window and the broadcast are small.
    sizes = ranged.groupBy(_PART).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        F.col(_PART).alias("_o_part"),
        F.coalesce(
            F.sum("_size").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    row = F.col("_offset") + F.col("_id") - F.shiftleft(F.col(_PART), 33) + 1
    numbered = ranged.join(F.broadcast(offsets), F.col(_PART) == F.col("_o_part")).withColumn("_row", row)
    numbered = numbered.drop(_PART, "_id", "_o_part", "_offset")
    if not ties:
        return numbered.withColumnRenamed("_row", name)

    # Equal rows share the smallest row number among them.
    starts = numbered.groupBy(*[F.col(t).alias(f"_e_{t}") for t in ties]).agg(F.min("_row").alias(name))
    match = F.lit(True)
    for t in ties:
        match = match & F.col(t).eqNullSafe(F.col(f"_e_{t}"))
    ranked = numbered.join(starts, match).drop(*[f"_e_{t}" for t in ties])
    return ranked.withColumnRenamed("_row", row_name) if row_name else ranked.drop("_row")


def ranked_page(
    df: DataFrame,
    order: Sequence[Column],
    limit: int,
    offset: int = 0,
    ties: Sequence[str] | None = None,
    name: str = "rank",
) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of the ranking, with their rank.

    The first ``offset + limit`` rows are a distributed top-k; ranks depend only on earlier
    rows, so numbering that prefix is exact.  For pages far down, ``deep_page`` ranks the table.
    """
    order = list(order)
    window = Window.orderBy(*order)
    number = F.rank().over(Window.orderBy(*order[: len(ties)])) if ties else F.row_number().over(window)
    top = df.orderBy(*order).limit(offset + limit)
    page = top.select("*", F.row_number().over(window).alias("_row"), number.cast("long").alias(name))
    return page.where(F.col("_row") > offset).drop("_row")


def deep_page(
    df: DataFrame, order: Sequence[Column], limit: int, offset: int, ties: Sequence[str] | None = None, name: str = "rank"
) -> DataFrame:
    """As ``ranked_page`` from the full ranking, for offsets too large to sort in one task."""
    place = "_place" if ties else name
    ranked = global_rank(df, order, ties=ties, name=name, row_name="_place" if ties else None)
    page = ranked.where(F.col(place).between(offset + 1, offset + limit))
    return page.drop("_place") if ties else page


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per group and map task before the
    shuffle, so a hot group arrives cut down.  Spark does this up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows (1000 by default).
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def page_count(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))
