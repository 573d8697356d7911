"""Statistics of one virtual round or one in-person session."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators.distribution import attempt_buckets, score_stats, with_segment
from turnout.operators.overlap import cohort_vs_prior, with_prior
from turnout.operators.roster import ci_equals
from turnout.operators.sessions import round_counts
from turnout.plans.crossover import CrossoverParams, crossover
from turnout.plans.leaderboards import session_scope
from turnout.session import pinned


def submission_totals(subs: DataFrame) -> DataFrame:
    """One row: submissions and distinct linked registrations."""
    return subs.agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_distinct("registration_id").alias("unique_registrations"),
        F.count("registration_id").alias("linked_submissions"),
    )


def segment_counts(segmented: DataFrame) -> DataFrame:
    """One row: submissions per team segment."""
    return segmented.agg(
        *[
            F.count(F.when(F.col("segment") == s, 1)).alias(f"team_segment_{s}")
            for s in ("unknown", "student", "professional", "other")
        ]
    )


def common_stats(subs: DataFrame, regs: DataFrame) -> dict[str, DataFrame]:
    """The metrics rounds and sessions share."""
    segmented = with_segment(subs, regs, "registration_id", "id", "occupation")
    charted = segmented.where(F.col("segment").isin("student", "professional"))
    return {
        "totals": submission_totals(subs),
        "scores": score_stats(subs, "total_score"),
        "segments": segment_counts(segmented),
        "attempts": attempt_buckets(segmented, "attempts_completed"),
        "segment_scores": score_stats(charted, "total_score", by=["segment"]),
    }


def chronological() -> list[Column]:
    return [F.col("closes_at").asc_nulls_last(), F.col("opens_at").asc_nulls_last(), F.col("id").asc()]


def round_stats(
    subs: DataFrame, regs: DataFrame, rounds: DataFrame, round_id: int, in_person: DataFrame | None = None,
    params: CrossoverParams | None = None,
) -> dict[str, DataFrame]:
    """Registrations at open and close, totals, scores, segments, attempts and cohorts of one round; with the
    in-person submissions also its crossover with them."""
    this = rounds.where(F.col("id") == round_id)
    out = common_stats(subs.where(F.col("challenge_id") == round_id), regs)
    out["registrations"] = round_counts(this, regs).select("id", "registrations_at_open", "registrations_at_close")
    cohorts = cohort_vs_prior(
        subs, with_prior(rounds, "id", chronological(), ["title"]).withColumnsRenamed(
            {"id": "challenge_id", "prior_id": "prior_challenge_id"}
        ), "challenge_id", "leader_email_normalized",
    )
    out["cohort"] = cohorts.where(F.col("challenge_id") == round_id)
    if in_person is not None and params is not None:
        out["crossover"] = crossover(in_person, subs, replace(params, round_ids=(round_id,)))[0]
    return out


def session_registrations(regs: DataFrame, city: str, on: date | None, label: str | None) -> DataFrame:
    """One row: registrations of a session; no date means the undated session."""
    scope = (
        ci_equals("attendance_city", city)
        & F.col("session_on").eqNullSafe(F.lit(on).cast("date"))
        & ci_equals("session_label", label or "")
    )
    return regs.where(scope).agg(F.count(F.lit(1)).alias("registrations"))


def session_chronology() -> list[Column]:
    return [F.col("session_on").asc_nulls_first(), F.lower(F.trim(F.coalesce("session_label", F.lit("")))), F.col("id")]


def session_cohorts(subs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct leaders of every dated session, split by presence in the event's previous session.

    The chronology, one row a session, is pinned: who was where, what came before and the result all read it, and none derives the sessions anew.
    """
    ordered = pinned(with_prior(sessions, "id", session_chronology(), by=["event_id"]).withColumnsRenamed(
        {"id": "session_id", "prior_id": "prior_session_id"}
    ))
    keyed = subs.where("sheet_kind = 'main'").select(
        "leader_email_normalized",
        F.lower(F.trim("attendance_city")).alias("_c"),
        F.col("session_on").alias("_d"),
        F.lower(F.trim(F.coalesce("session_label", F.lit("")))).alias("_l"),
    ).distinct()
    key = ordered.select(
        "session_id",
        F.lower(F.trim("city")).alias("_sc"),
        F.col("session_on").alias("_sd"),
        F.lower(F.trim(F.coalesce("session_label", F.lit("")))).alias("_sl"),
    )
    member_of = keyed.join(
        key, (F.col("_c") == F.col("_sc")) & (F.col("_d") == F.col("_sd")) & (F.col("_l") == F.col("_sl"))
    ).select("leader_email_normalized", "session_id")
    return cohort_vs_prior(member_of, ordered, "session_id", "leader_email_normalized")


def session_stats(
    subs: DataFrame, regs: DataFrame, sessions: DataFrame, city: str, on: date | None, label: str | None,
    virtual: DataFrame | None = None, params: CrossoverParams | None = None,
) -> dict[str, DataFrame]:
    """Registrations, totals, scores, segments, attempts and cohorts of one in-person session; with the virtual
    submissions also its crossover with them."""
    out = common_stats(subs.where(session_scope(city, on, label)), regs)
    out["registrations"] = session_registrations(regs, city, on, label)
    here = (
        ci_equals("city", city) & F.col("session_on").eqNullSafe(F.lit(on).cast("date"))
        & ci_equals("session_label", label or "")
    )
    out["cohort"] = session_cohorts(subs, sessions).where(here)
    if virtual is not None and params is not None:
        out["crossover"] = crossover(subs.where(session_scope(city, on, label)), virtual, params)[0]
    return out
