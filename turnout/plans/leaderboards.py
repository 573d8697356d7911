"""Leaderboards, the conversion funnel and ledger scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.numbers import MONEY, at_least_one, ratio
from turnout.operators.ordering import ranked_page, top_per_group
from turnout.operators.roster import ci_equals

TEAM_COLUMNS = ("team_name", "leader_name", "leader_email", "total_score")


def score_order(score: str = "total_score", at: str = "export_created_at", row_id: str = "id") -> list[Column]:
    """Best score first, unscored last, then the earliest, then the lowest id."""
    return [F.col(score).desc_nulls_last(), F.col(at).asc_nulls_last(), F.col(row_id).asc()]


def round_leaderboard(subs: DataFrame, limit: int = 50, offset: int = 0,
                      columns: Sequence[str] = TEAM_COLUMNS) -> DataFrame:
    """One page of the teams of one round (``subs`` already filtered to it)."""
    rows = subs.select("id", "export_created_at", *columns)
    page = ranked_page(rows, score_order(), limit, offset)
    return page.select("rank", *columns, F.col("export_created_at").alias("submitted_at"))


def round_tops(subs: DataFrame, limit: int, columns: Sequence[str] = TEAM_COLUMNS) -> DataFrame:
    """The best teams of every round, in one job."""
    rows = subs.where("challenge_id IS NOT NULL").select("challenge_id", "id", "export_created_at", *columns)
    top = top_per_group(rows, ["challenge_id"], score_order(), limit)
    place = F.row_number().over(Window.partitionBy("challenge_id").orderBy(*score_order()))
    return top.select("challenge_id", place.alias("rank"), *columns, F.col("export_created_at").alias("submitted_at"))


def session_scope(city: str, on: date | None = None, label: str | None = None, every_date: bool = False) -> Column:
    """Main-sheet rows of one session.

    No date means the undated session, unless ``every_date`` asks for all sessions of the city.
    """
    scope = (F.col("sheet_kind") == "main") & ci_equals("attendance_city", city)
    if every_date:
        return scope
    scope = scope & F.col("session_on").eqNullSafe(F.lit(on).cast("date"))
    return scope & ci_equals("session_label", label or "")


def session_leaderboard(subs: DataFrame, scope: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """In-person main-sheet teams, all or of one session."""
    rows = subs.where(F.col("sheet_kind") == "main" if scope is None else scope)
    return round_leaderboard(rows, limit, offset, (*TEAM_COLUMNS, "attendance_city"))


def leader_averages(subs: DataFrame) -> DataFrame:
    """Per leader: mean score over rounds (missing counts as zero), first submission, round count, best row's names."""
    score, at = F.col("total_score"), F.col("export_created_at")
    # Smallest position = best score, unscored last, then earliest, then lowest id.
    position = F.struct(score.isNull().alias("a"), (-score).alias("b"), at.isNull().alias("c"), at.alias("d"), "id")
    names = F.struct("team_name", "leader_name", "leader_email")
    per_leader = subs.groupBy("leader_email_normalized").agg(
        (F.sum(F.coalesce(score, F.lit(0).cast(MONEY))).cast("double") / F.count(F.lit(1))).alias("average_score"),
        F.min(at).alias("submitted_at"),
        F.count_distinct("challenge_id").alias("arena_count"),
        F.min_by(names, position).alias("best"),
    )
    return per_leader.select(
        "leader_email_normalized", "best.*", "average_score", "submitted_at", "arena_count"
    )


def global_leaderboard(subs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    order = score_order("average_score", "submitted_at", "leader_email_normalized")
    return ranked_page(leader_averages(subs), order, at_least_one(limit, "limit"), max(offset, 0))


def ledger_scores(enrolled: DataFrame, ledger: DataFrame, round_id: int | str | None = None) -> DataFrame:
    """Summed credits per enrolled participant, zero without any; one round or all."""
    entries = ledger if round_id is None else ledger.where(F.col("challenge_id") == F.lit(round_id))
    sums = entries.groupBy(F.col("participant_id").alias("_pid")).agg(F.sum(F.col("delta").cast(MONEY)).alias("_sum"))
    return enrolled.join(sums, F.col("participant_id") == F.col("_pid"), "left").select(
        *enrolled.columns, F.coalesce("_sum", F.lit(0).cast("decimal(24,4)")).alias("score")
    )


def balance_scores(enrolled: DataFrame, balances: DataFrame) -> DataFrame:
    """Stored balance per enrolled participant, zero without one."""
    side = balances.select(F.col("participant_id").alias("_pid"), "balance")
    return enrolled.join(side, F.col("participant_id") == F.col("_pid"), "left").select(
        *enrolled.columns, F.coalesce("balance", F.lit(0).cast("decimal(24,4)")).alias("score")
    )


def ranked_scores(scores: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of participants by score; equal scores share a rank."""
    order = [F.desc("score"), F.asc("participant_id")]
    return ranked_page(scores, order, limit, offset, ties=["score"])


def conversion_funnel(dim: DataFrame, top: DataFrame, bottom: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct members at the top and bottom of the funnel per dimension row, and their ratio."""
    # One aggregation over both facts: tag, reduce to distinct members, count the tags.
    tagged = top.select(key, member, F.lit(1).alias("_t"), F.lit(0).alias("_b")).unionByName(
        bottom.select(key, member, F.lit(0).alias("_t"), F.lit(1).alias("_b"))
    )
    members = tagged.groupBy(key, member).agg(F.max("_t").alias("_t"), F.max("_b").alias("_b"))
    counted = members.where(F.col(member).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.sum("_t").alias("_top"), F.sum("_b").alias("_bottom")
    )
    zero = F.lit(0).cast("long")
    return (
        dim.join(counted, F.col(key) == F.col("_key"), "left")
        .select(
            *dim.columns,
            F.coalesce("_top", zero).alias("rsvp_count"),
            F.coalesce("_bottom", zero).alias("submission_count"),
        )
        .withColumn("conversion_rate", ratio("submission_count", "rsvp_count"))
    )


def missing_in_action(top: DataFrame, bottom: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that reached the top of the funnel but not the bottom."""
    tagged = top.select(*keys, F.lit(0).alias("_b")).unionByName(bottom.select(*keys, F.lit(1).alias("_b")))
    return (
        tagged.groupBy(*keys).agg(F.min("_b").alias("_top"), F.max("_b").alias("_bottom"))
        .where("_top = 0 AND _bottom = 0").select(*keys)
    )
