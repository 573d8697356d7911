"""Overlap, cohorts and retention on distinct members.

Every question here is answered by one aggregation per member: each input row is tagged,
a member's tags are combined map-side, and the flags are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.numbers import at_least_one


def member_flags(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per non-blank key with a flag per side."""
    tagged = None
    for name, df in sides.items():
        one = df.select(
            F.col(key).alias(key), *[F.lit(other == name).alias(f"in_{other}") for other in sides]
        )
        tagged = one if tagged is None else tagged.unionByName(one)
    tagged = tagged.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return tagged.groupBy(key).agg(*[F.max(f"in_{s}").alias(f"in_{s}") for s in sides])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_a, n_b, both, a_only, b_only over distinct keys."""
    flags = member_flags({"a": a, "b": b}, key)
    in_a, in_b = F.col("in_a"), F.col("in_b")
    return flags.agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & in_b).alias("both"),
        F.count_if(in_a & ~in_b).alias("a_only"),
        F.count_if(in_b & ~in_a).alias("b_only"),
    )


def with_prior(rounds: DataFrame, round_id: str, order: Sequence[Column], carry: Sequence[str] = (),
               by: Sequence[str] = ()) -> DataFrame:
    """Each round with the id (and carried columns) of the one before it.

    ``rounds`` is the round table, one row per round or session.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return rounds.select(
        "*",
        F.lag(round_id).over(window).alias(f"prior_{round_id}"),
        *[F.lag(c).over(window).alias(f"prior_{c}") for c in carry],
    )


def cohort_vs_prior(subs: DataFrame, rounds: DataFrame, round_id: str, member: str) -> DataFrame:
    """Distinct members per round, split into fresh and returning from the prior round.

    ``rounds`` comes from :func:`with_prior`.  A member's set of rounds is at most the number
    of rounds, however many rows the member has.
    """
    attended = (
        subs.where(F.col(member).isNotNull() & F.col(round_id).isNotNull())
        .groupBy(member)
        .agg(F.collect_set(round_id).alias("_rounds"))
    )
    each = attended.select(F.explode("_rounds").alias("_round"), "_rounds")
    prior = rounds.select(F.col(round_id), F.col(f"prior_{round_id}").alias("_prior"))
    returning = F.coalesce(F.array_contains("_rounds", F.col("_prior")), F.lit(False))
    counted = (
        each.join(prior, F.col("_round") == F.col(round_id))
        .groupBy("_round")
        .agg(
            F.count(F.lit(1)).alias("distinct_teams"),
            F.count_if(returning).alias("returning_from_prior"),
            F.count_if(~returning).alias("fresh_vs_prior"),
        )
    )
    zero = F.lit(0).cast("long")
    return rounds.join(counted, F.col(round_id) == F.col("_round"), "left").select(
        *rounds.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("distinct_teams", "returning_from_prior", "fresh_vs_prior")],
    )


def retention_top_n(
    subs: DataFrame, first_round: object, second_round: object, round_id: str, member: str, score: str, at: str, n: int
) -> DataFrame:
    """Members of the first round also in the second, and the same for its top ``n`` by best score."""
    n = at_least_one(n, "n")
    in_1, in_2 = F.col(round_id) == F.lit(first_round), F.col(round_id) == F.lit(second_round)
    per_member = subs.where(in_1 | in_2).groupBy(member).agg(
        F.max(in_1).alias("_in_1"),
        F.max(in_2).alias("_in_2"),
        F.max(F.when(in_1, F.col(score))).alias("_best"),
        F.min(F.when(in_1, F.col(at))).alias("_first"),
    )
    top = (
        per_member.where("_in_1")
        .orderBy(F.col("_best").desc_nulls_last(), F.col("_first").asc_nulls_last(), F.col(member))
        .limit(n)
    )
    kept = top.agg(F.count_if("_in_2").alias("n")).scalar()
    return per_member.agg(
        F.count_if("_in_1").alias("first_distinct"),
        F.count_if("_in_2").alias("second_distinct"),
        F.count_if(F.col("_in_1") & F.col("_in_2")).alias("first_also_in_second"),
    ).withColumn("top_n_also_in_second", kept)
