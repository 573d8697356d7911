"""Report sections and exports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.text import coalesce_label, not_blank
from turnout.operators.counts import last_n_days
from turnout.operators.overlap import member_flags, retention_top_n
from turnout.operators.sessions import round_counts
from turnout.plans.leaderboards import round_tops, session_leaderboard


def submission_counts(subs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return subs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_distinct("leader_email_normalized").alias("unique_submitters"),
        F.count(F.when(not_blank("deployed_link"), 1)).alias("deployed_count"),
        F.count("total_score").alias("scored_count"),
    )


def round_summary(rounds: DataFrame, regs: DataFrame, subs: DataFrame) -> DataFrame:
    """Per round: registrations at open, at close and between; submission counts."""
    per_round = submission_counts(subs, ("challenge_id",)).withColumnRenamed("challenge_id", "_round")
    zero = F.lit(0).cast("long")
    counts = [c for c in per_round.columns if c != "_round"]
    counted = round_counts(rounds, regs)
    return counted.join(per_round, F.col("id") == F.col("_round"), "left").select(
        *counted.columns,
        (F.col("registrations_at_close") - F.col("registrations_at_open")).alias("registrations_during_window"),
        *[F.coalesce(c, zero).alias(c) for c in counts],
    )


def city_breakdown(regs: DataFrame, as_of: datetime) -> DataFrame:
    """Registrations, all and of the last seven days, per attendance city (else city)."""
    return (
        regs.groupBy(coalesce_label("attendance_city", "city", default="<unknown>").alias("city"))
        .agg(
            F.count(F.lit(1)).alias("registrations"),
            F.count(F.when(last_n_days("form_timestamp", as_of), 1)).alias("last_7_days"),
        )
        .orderBy(F.desc("registrations"), "city")
    )


def in_person_summary(regs: DataFrame, subs: DataFrame, as_of: datetime) -> DataFrame:
    """One row: registrations, last seven days, cities, and main and warm-up submission totals."""
    place = F.coalesce(F.nullif(F.trim("attendance_city"), F.lit("")), F.nullif(F.trim("city"), F.lit("")))
    head = regs.agg(
        F.struct(
            F.count(F.lit(1)).alias("registrations"),
            F.count(F.when(last_n_days("form_timestamp", as_of), 1)).alias("last_7_days"),
            F.count_distinct(place).alias("distinct_cities"),
        ).alias("h")
    ).scalar()
    main = F.col("sheet_kind") == "main"

    def only(c: Column) -> Column:
        return F.when(main, c)

    return subs.agg(
        F.count(only(F.lit(1))).alias("main_submissions"),
        F.count_distinct(only(F.col("leader_email_normalized"))).alias("main_leaders"),
        F.count(only(F.when(not_blank("deployed_link"), 1))).alias("main_deployed"),
        F.count(only(F.col("total_score"))).alias("main_scored"),
        F.count_distinct(only(F.lower(F.trim("attendance_city")))).alias("cities_with_submissions"),
        F.count(F.when(F.col("sheet_kind") == "warmup", 1)).alias("warmup_submissions"),
    ).select(
        head["registrations"].alias("registrations"),
        head["last_7_days"].alias("last_7_days"),
        head["distinct_cities"].alias("distinct_cities"),
        "*",
    )


def track_overlap_report(ip_regs: DataFrame, v_regs: DataFrame, v_subs: DataFrame) -> DataFrame:
    """One row: in-person e-mails, those also registered and those also submitting in the virtual track."""
    flags = member_flags(
        {
            "ip": ip_regs.select(F.col("email_normalized").alias("email")),
            "reg": v_regs.select(F.col("email_normalized").alias("email")),
            "sub": v_subs.select(F.col("leader_email_normalized").alias("email")),
        },
        "email",
    )
    return flags.agg(
        F.count_if("in_ip").alias("in_person_distinct_emails"),
        F.count_if(F.col("in_ip") & F.col("in_reg")).alias("also_registered_virtual"),
        F.count_if(F.col("in_ip") & F.col("in_sub")).alias("also_submitted_virtual"),
    )


def report_sections(
    ip_regs: DataFrame, v_regs: DataFrame, ip_subs: DataFrame, v_subs: DataFrame, rounds: DataFrame, as_of: datetime,
    top_n: int = 400,
) -> dict[str, DataFrame]:
    """All report sections by name; one section lists the top teams of every round."""
    ids = [r[0] for r in rounds.orderBy(F.col("opens_at").asc_nulls_last(), "id").select("id").limit(2).collect()]
    out = {
        "Summary": track_overlap_report(ip_regs, v_regs, v_subs),
        "InPerson": in_person_summary(ip_regs, ip_subs, as_of),
        "Cities": city_breakdown(ip_regs, as_of),
        "Top10": session_leaderboard(ip_subs, limit=10),
        "Virtual": submission_counts(v_subs),
        "Challenges": round_summary(rounds, v_regs, v_subs),
    }
    out["Teams"] = round_tops(v_subs, top_n)
    if len(ids) >= 2:
        out["Retention"] = retention_top_n(
            v_subs, ids[0], ids[1], "challenge_id", "leader_email_normalized", "total_score", "export_created_at", top_n
        )
    return out


def export_report(sections: Mapping[str, DataFrame], folder: str) -> None:
    """Write every section to its own folder; one with rounds has a folder for each of them."""
    for name, section in sections.items():
        writer = section.write.mode("overwrite")
        by_round = "challenge_id" in section.columns and "rank" in section.columns
        (writer.partitionBy("challenge_id") if by_round else writer).parquet(f"{folder}/{name.replace(' ', '_')}")


#: Columns of a roster export; the score belongs to the virtual track, the session to the in-person one.
EXPORT_COLUMNS = (
    "id", "email", "full_name", "profile_name", "mobile", "country", "state", "city", "gender", "occupation",
    "designation", "designation_years", "form_timestamp",
)


def export_rows(rows: DataFrame, mode: str = "in_person") -> DataFrame:
    """Roster rows as text in the fixed column order, NULL as the empty string."""
    extra = ("submission_score",) if mode == "virtual" else ("attendance_city", "session_on", "session_label")
    wanted = [c for c in (*EXPORT_COLUMNS, *extra) if c in rows.columns]
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in wanted])


def export_csv(rows: DataFrame, folder: str, mode: str = "in_person") -> None:
    """CSV with header, blanks kept; the byte-order mark leads the header of every part file."""
    out = export_rows(rows, mode)
    first, *rest = out.columns
    out.toDF("﻿" + first, *rest).write.mode("overwrite").options(
        header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
