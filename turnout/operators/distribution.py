"""Histograms, score statistics and exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.classify import attempt_bucket, segment_case
from turnout.functions.numbers import at_least_one
from turnout.operators.ordering import bucketed_total

QUARTILES = (0.25, 0.5, 0.75)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the value range: bin, low, high, count; empty bins are kept.

    The last bin is closed.  One distinct value gives one bin, no value gives none.
    """
    bins = at_least_one(bins, "bins")
    values = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    # A scalar subquery: the range is computed once and no join is needed.
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / F.lit(float(bins))
    slot = F.when(lo == hi, 0).otherwise(
        F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
    ).cast("int")
    counts = values.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    frame = frame.where(lo.isNotNull() & ((F.col("bin") == 0) | (lo < hi)))
    high = F.when((F.col("bin") == bins - 1) | (lo == hi), hi).otherwise(lo + (F.col("bin") + 1) * width)
    return frame.join(counts, F.col("bin") == F.col("slot"), "left").select(
        "bin",
        (lo + F.col("bin") * F.when(lo == hi, 0.0).otherwise(width)).alias("low"),
        high.alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )


def mean(df: DataFrame, score: str) -> Column:
    """Average as a double; decimal scores are summed exactly first."""
    if df.schema[score].dataType.typeName() == "decimal":
        n = F.count(score)
        return F.when(n > 0, F.sum(score).cast("double") / n)
    return F.avg(F.col(score).cast("double"))


def score_rollup(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Row and scored counts, min, max, mean and population deviation of a score."""
    x = F.col(score).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_n"),
        F.count(score).alias("scored_n"),
        F.min(x).alias("min_score"),
        F.max(x).alias("max_score"),
        mean(df, score).alias("avg_score"),
        F.stddev_pop(x).alias("stddev_score"),
    )


def value_levels(value: Column) -> list[Column]:
    """Buckets of a number, coarse and fine: a thousandth of its size, and the 4096 parts of that; neither decreases as the value grows."""
    size = F.log1p(F.abs(value)) * 1024
    signed = F.when(value < 0, -size).otherwise(size)
    return [F.floor(signed), F.floor((signed - F.floor(signed)) * 4096)]


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact interpolated percentiles per group, as the array ``percentiles``.

    The distinct values are counted and walked by a running total over buckets of a thousandth of their size, each cut again by the next twelve
    binary digits, so a group holding a third of all rows is spread over many tasks, also where its values lie close together.
    """
    by = list(by)
    x = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = x.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = bucketed_total(counted, [F.col("_v")], value_levels(F.col("_v")), F.col("_c"), "_hi", by, "_n")
    first = F.col("_hi") - F.col("_c")

    def holds(k: Column) -> Column:
        return (first <= k) & (k < F.col("_hi"))

    spots = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    wanted = F.lit(False)
    for spot in spots:
        wanted = wanted | holds(F.floor(spot)) | holds(F.ceil(spot))
    low = [F.max(F.when(holds(F.floor(s)), F.col("_v"))) for s in spots]
    high = [F.max(F.when(holds(F.ceil(s)), F.col("_v"))) for s in spots]
    part = [F.max(s - F.floor(s)) for s in spots]
    return (
        run.where(wanted)
        .groupBy(*by)
        .agg(F.array(*[a + (b - a) * f for a, b, f in zip(low, high, part)]).alias("percentiles"))
    )


def score_stats(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """n, min, max, avg, sample deviation, quartiles and range of the scored rows per group.

    Without ``by`` there is one row, also for no input.
    """
    by = list(by)
    x = F.col(score).cast("double")
    base = df.groupBy(*by).agg(
        F.count(score).alias("n_scored"),
        F.min(x).alias("min_score"),
        F.max(x).alias("max_score"),
        mean(df, score).alias("avg_score"),
        F.stddev_samp(x).alias("stddev_score"),
    )
    if by:
        marks = exact_percentiles(df, score, by=by)
        marks = marks.select(*[F.col(k).alias(f"_m_{k}") for k in by], "percentiles")
        match = F.lit(True)
        for k in by:
            match = match & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        joined = base.join(marks, match, "left")
    else:
        whole = exact_percentiles(df.withColumn("_all", F.lit(1)), score, by=["_all"])
        joined = base.withColumn("percentiles", whole.select("percentiles").scalar())
    return joined.select(
        *by,
        "n_scored",
        "min_score",
        "max_score",
        "avg_score",
        "stddev_score",
        F.col("percentiles")[0].alias("p25"),
        F.col("percentiles")[1].alias("median"),
        F.col("percentiles")[2].alias("p75"),
        (F.col("max_score") - F.col("min_score")).alias("score_range"),
    )


def with_segment(subs: DataFrame, regs: DataFrame, link: str, reg_id: str, occupation: str) -> DataFrame:
    """Add ``segment`` from the linked registration's occupation.

    Unlinked submissions, often a large share, skip the join: as NULL keys they would all meet
    in one partition.
    """
    side = regs.select(F.col(reg_id).alias("_reg_id"), F.col(occupation).alias("_occupation"))
    linked = (
        subs.where(F.col(link).isNotNull())
        .join(side, F.col(link) == F.col("_reg_id"), "left")
        .withColumn("segment", segment_case("_occupation", link))
        .drop("_reg_id", "_occupation")
    )
    return linked.unionByName(subs.where(F.col(link).isNull()).withColumn("segment", F.lit("unknown")))


def attempt_buckets(segmented: DataFrame, attempts: str, by: Sequence[str] = ()) -> DataFrame:
    """Submissions per attempt bucket for students and professionals."""
    return (
        segmented.where(F.col("segment").isin("student", "professional"))
        .groupBy(*by, "segment", attempt_bucket(attempts).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
