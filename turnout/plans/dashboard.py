"""The registration dashboard and the programme overview."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import business_date, completed_years, effective_range
from turnout.functions.numbers import ratio
from turnout.functions.text import coalesce_label, initcap_words, not_blank
from turnout.operators.counts import (
    daily_counts,
    facet_counts,
    hourly_counts,
    in_business_days,
    label_counts,
    last_n_days,
    recent_daily_counts,
)
from turnout.operators.distribution import score_rollup
from turnout.operators.overlap import overlap
from turnout.plans.leaderboards import global_leaderboard, round_leaderboard, session_leaderboard

TS = "form_timestamp"


def date_bounds(regs: DataFrame) -> DataFrame:
    """One row: first and last business day with a registration."""
    day = business_date(TS)
    return regs.agg(F.min(day).alias("date_min"), F.max(day).alias("date_max"))


def state_label() -> Column:
    return initcap_words(F.nullif(F.trim("state"), F.lit("")))


def top_city_label(mode: str) -> Column:
    """City of residence for the virtual track; attendance city first for the in-person one."""
    city = F.nullif(F.trim("city"), F.lit(""))
    return city if mode == "virtual" else F.coalesce(F.nullif(F.trim("attendance_city"), F.lit("")), city)


def registration_totals(regs: DataFrame, as_of: datetime) -> DataFrame:
    """All scalar metrics of the dashboard in one aggregation."""
    age = completed_years("dob", F.lit(as_of.date()))
    born = F.col("dob").isNotNull()
    return regs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(not_blank("attendance_city"), 1)).alias("with_attendance_city"),
        F.count_distinct(F.nullif(F.trim("country"), F.lit(""))).alias("distinct_countries"),
        F.count_distinct(F.nullif(F.trim("state"), F.lit(""))).alias("distinct_states"),
        F.max("updated_at").alias("last_updated"),
        F.round(F.avg(F.when(born, age)), 1).alias("average_age"),
        F.count(F.when(born, 1)).alias("with_dob"),
        F.count(F.when(last_n_days(TS, as_of), 1)).alias("last_7_days"),
    )


def dashboard_facets(mode: str) -> dict[str, tuple[Column, int | None]]:
    """The dashboard's counted labels and how many of each it shows."""
    return {
        "attendance_cities": (F.nullif(F.trim("attendance_city"), F.lit("")), None),
        "utm_sources": (coalesce_label("utm_source", default="(none)"), 8),
        "top_city": (top_city_label(mode), 1),
        "top_state": (state_label(), 1),
        "states": (state_label(), 36),
        "cities": (coalesce_label("attendance_city", "city", default="(Unknown)"), 40),
        "genders": (coalesce_label("gender", default="(unspecified)"), 8),
        "occupations": (coalesce_label("occupation", default="(unspecified)"), 8),
    }


def dashboard_labels(regs: DataFrame, mode: str = "in_person") -> DataFrame:
    """All label counts of the dashboard, as (facet, rank, label, n), in one scan of the registrations."""
    return facet_counts(regs, dashboard_facets(mode))


def registration_dashboard(
    regs: DataFrame, as_of: datetime, mode: str = "in_person", date_from: date | None = None,
    date_to: date | None = None, other_track: DataFrame | None = None, ip_subs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every dashboard metric as its own DataFrame; nothing is evaluated but the data's date bounds.

    ``labels`` holds all label counts together, for one scan in place of one for each.
    A requested range is clamped to the data and narrows all metrics but the bounds.
    """
    bounds = date_bounds(regs)
    days = effective_range(date_from, date_to, *bounds.first()) if (date_from or date_to) else None
    rows = regs.where(in_business_days(TS, *days)) if days else regs
    today = as_of.date()
    out = {
        "bounds": bounds,
        "totals": registration_totals(rows, as_of),
        "labels": dashboard_labels(rows, mode),
        "hourly": hourly_counts(rows, TS),
        "timeline": daily_counts(rows, TS, *days) if days else recent_daily_counts(rows, TS, today),
        **{name: label_counts(rows, label, most) for name, (label, most) in dashboard_facets(mode).items()},
    }
    if days:
        first = max(days[0], days[1] - timedelta(days=6))
        out["last_7_days"] = rows.where(in_business_days(TS, first, days[1])).agg(F.count(F.lit(1)).alias("n"))
    if other_track is not None:
        out["track_overlap"] = overlap(rows, other_track, "email_normalized")
    if ip_subs is not None:
        leaders = ip_subs.select(F.col("leader_email_normalized").alias("_leader")).distinct()
        out["led_in_person"] = rows.join(leaders, F.col("email_normalized") == F.col("_leader"), "left_semi").agg(
            F.count_distinct("email_normalized").alias("n")
        )
    return out


def registration_brief(regs: DataFrame, as_of: datetime, mode: str = "in_person") -> DataFrame:
    """One row: total, last seven days, top city, top state, average age."""
    city = label_counts(regs, top_city_label(mode), 1).select("label").scalar()
    state = label_counts(regs, state_label(), 1).select("label").scalar()
    totals = registration_totals(regs, as_of).select("total", "last_7_days", "average_age")
    return totals.withColumn("top_city", city).withColumn("top_state", state)


def overview_counts(regs: DataFrame, subs: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: registrants, submissions, leaders, credits granted, and submitting leaders per registrant in percent."""
    n_regs = regs.agg(F.count(F.lit(1)).alias("n")).scalar()
    credits = ledger.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("double").alias("n")).scalar()
    return subs.agg(
        F.count(F.lit(1)).alias("submissions"),
        F.count_distinct("leader_email_normalized").alias("leaders"),
    ).select(
        n_regs.alias("registrations"),
        "submissions",
        "leaders",
        credits.alias("credits"),
        ratio(F.col("leaders") * 100.0, n_regs, 2).alias("conversion_pct"),
    )


def overview(regs: DataFrame, v_subs: DataFrame, ip_subs: DataFrame, ledger: DataFrame, as_of: datetime,
             round_id: int) -> dict[str, DataFrame]:
    """The landing page: brief, score roll-ups, leaderboards and counts."""
    return {
        "brief": registration_brief(regs, as_of),
        "virtual_scores": score_rollup(v_subs, "total_score"),
        "round_scores": score_rollup(v_subs.where(F.col("challenge_id") == round_id), "total_score"),
        "in_person_scores": score_rollup(ip_subs.where("sheet_kind = 'main'"), "total_score"),
        "round_leaderboard": round_leaderboard(v_subs.where(F.col("challenge_id") == round_id), 10),
        "global_leaderboard": global_leaderboard(v_subs, 10),
        "session_leaderboard": session_leaderboard(ip_subs, limit=10),
        "counts": overview_counts(regs, v_subs, ledger),
    }
