"""Counts by label, day and hour; facets; counts at moments; alias roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.dates import business_date, business_hour
from turnout.functions.text import as_col, not_blank
from turnout.operators.ordering import bucketed_total, top_per_group


def label_counts(df: DataFrame, label: Column | str, n: int | None = None, name: str = "label") -> DataFrame:
    """Rows per non-NULL label, most frequent first, ties by label; all labels or the first ``n``."""
    counted = (
        df.select(as_col(label).alias(name)).where(F.col(name).isNotNull())
        .groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = counted.orderBy(F.desc("n"), F.asc(name))
    return ordered.limit(n) if n is not None else ordered


def facet_counts(df: DataFrame, facets: Mapping[str, tuple[Column, int | None]]) -> DataFrame:
    """(facet, rank, label, n) of several labels at once: rows per non-NULL label, most frequent first, ties by label.

    ``facets`` gives each label's column and how many of its values to keep (None: all).  All are counted in one scan and one aggregation, which Spark combines
    before its shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), label.cast("string").alias("label")) for name, (label, _) in facets.items()]))
    counted = df.select(pairs.alias("p")).select("p.facet", "p.label").where("label IS NOT NULL").groupBy("facet", "label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("label"))
    ranked = counted.withColumn("rank", F.row_number().over(order))
    kept = F.lit(False)
    for name, (_, most) in facets.items():
        here = F.col("facet") == name
        kept = kept | (here if most is None else here & (F.col("rank") <= most))
    return ranked.where(kept).select("facet", "rank", "label", "n")


def facet_values(df: DataFrame, columns: Sequence[str], cap: int | None = None) -> DataFrame:
    """Distinct non-blank trimmed values of each column, all or the first ``cap``, in one scan."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("facet"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])
    )
    values = df.select(pairs.alias("p")).select("p.facet", "p.value").where(not_blank("value")).distinct()
    return values if cap is None else top_per_group(values, ["facet"], [F.asc("value")], cap)


def options_with_extras(df: DataFrame, column: str, extras: Sequence[str] = ()) -> DataFrame:
    """Distinct trimmed values plus configured extras not present in any case, case-folded order."""
    values = df.select(F.trim(F.col(column)).alias("value")).where(not_blank("value")).distinct()
    spark = df.sparkSession
    if extras:
        more = spark.createDataFrame([(e.strip(),) for e in extras if e.strip()], "value string")
        have = values.select(F.lower("value").alias("_have")).distinct()
        more = more.join(have, F.lower("value") == F.col("_have"), "left_anti").dropDuplicates(["value"])
        values = values.unionByName(more)
    return values.orderBy(F.lower("value"), "value")


def in_business_days(ts: Column | str, first: date, last: date) -> Column:
    """Inclusive range of business days; NULL times are outside."""
    return business_date(ts).between(F.lit(first), F.lit(last))


def last_n_days(ts: Column | str, as_of: datetime, n: int = 7) -> Column:
    """Rolling window ending at ``as_of``."""
    start = F.lit((as_of - timedelta(days=n)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return as_col(ts).cast("timestamp_ntz") >= start


def daily_counts(df: DataFrame, ts: str, first: date, last: date) -> DataFrame:
    """Rows per business day from ``first`` to ``last``, days without rows included."""
    counted = (
        df.select(business_date(ts).alias("_day")).where(F.col("_day").between(F.lit(first), F.lit(last)))
        .groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    )
    calendar = df.sparkSession.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("day")
    )
    return calendar.join(counted, F.col("day") == F.col("_day"), "left").select(
        "day", F.coalesce("_n", F.lit(0)).cast("long").alias("n")
    )


def recent_daily_counts(df: DataFrame, ts: str, today: date, days: int = 120) -> DataFrame:
    return daily_counts(df, ts, today - timedelta(days=days - 1), today)


def hourly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per business hour of day, all 24 hours."""
    counted = (
        df.where(F.col(ts).isNotNull()).groupBy(business_hour(ts).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    )
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(counted, F.col("hour") == F.col("_hour"), "left").select(
        "hour", F.coalesce("_n", F.lit(0)).cast("long").alias("n")
    )


def counts_not_after(
    points: DataFrame, ts: str, moments: DataFrame, moment: str, name: str = "n", by: Sequence[str] = ()
) -> DataFrame:
    """For each distinct non-NULL moment of each ``by`` group, how many points of the group are at or before it.

    The moments are merged into the counted points and read off a running total by day, minute of the day and moment, so no point is ever paired
    with a moment and no task holds more than a minute's distinct moments.
    """
    by = list(by)
    marks = moments.select(*by, F.col(moment).alias("_at")).where("_at IS NOT NULL").distinct()
    kind = marks.schema["_at"].dataType
    seen = points.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).cast(kind).alias("_at")).agg(
        F.count(F.lit(1)).alias("_points")
    )
    line = seen.withColumn("_mark", F.lit(False)).unionByName(
        marks.withColumn("_points", F.lit(0).cast("long")).withColumn("_mark", F.lit(True))
    )
    levels = [F.to_date("_at"), F.hour("_at") * 60 + F.minute("_at")]
    run = bucketed_total(line, [F.col("_at"), F.col("_mark")], levels, F.col("_points"), "_n", by)
    return run.where("_mark").select(*by, F.col("_at").alias(moment), F.col("_n").alias(name))


def alias_rollup(
    counts: DataFrame, label: str, amount: str, names: Sequence[str], aliases: Mapping[str, str]
) -> DataFrame:
    """Sum counts under canonical names; spelling variants map through ``aliases``, absent names get zero."""
    def key(text: str) -> str:
        return " ".join(text.lower().replace("_", " ").split())

    canonical = {key(n): n for n in names}
    pairs = dict(canonical)
    pairs.update({key(a): canonical.get(key(n), n) for a, n in aliases.items() if key(n) in canonical})
    spark = counts.sparkSession
    lookup = spark.createDataFrame(list(pairs.items()), "_key string, name string")
    cleaned = F.lower(F.trim(F.regexp_replace(F.replace(F.col(label), F.lit("_"), F.lit(" ")), r"\s+", " ")))
    sums = (
        counts.withColumn("_key", cleaned).join(lookup, "_key").groupBy("name").agg(F.sum(amount).alias("_sum"))
    )
    every = spark.createDataFrame([(n,) for n in names], "name string")
    return every.join(sums, "name", "left").select("name", F.coalesce("_sum", F.lit(0)).alias("value"))


#: Older spellings of Indian states and the name used on the map.
STATE_ALIASES = {
    "orissa": "Odisha",
    "uttaranchal": "Uttarakhand",
    "nct of delhi": "Delhi",
    "pondicherry": "Puducherry",
    "dadra and nagar haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "daman and diu": "Dadra and Nagar Haveli and Daman and Diu",
    "d and n haveli": "Dadra and Nagar Haveli and Daman and Diu",
    "jammu & kashmir": "Jammu and Kashmir",
}
