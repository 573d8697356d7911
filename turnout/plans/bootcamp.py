"""Bootcamp sessions: options and activation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.text import bootcamp_display, slot_name


def bootcamp_history(sessions: DataFrame) -> DataFrame:
    """Activations of every session, newest first."""
    return sessions.orderBy(F.desc("bootcamp_on"), "city", "slot").select(
        bootcamp_display("city", "bootcamp_on", "slot").alias("batch_label"),
        F.coalesce("activations", F.lit(0)).alias("activations"),
        F.trim("city").alias("city"), "bootcamp_on", F.lower(F.trim("slot")).alias("slot"),
    )


def bootcamp_options(sessions: DataFrame) -> DataFrame:
    """Selectable sessions: a city and a known slot are needed."""
    return bootcamp_history(sessions.where((F.trim("city") != "") & slot_name("slot").isNotNull()))


def bootcamp_tiles(sessions: DataFrame, city: str, on: str, slot: str) -> DataFrame:
    """One row: attendees, activations, students and professionals of one session, zero when unknown."""
    slug = "_".join(city.strip().lower().split())
    here = sessions.where(
        (F.col("city") == slug) & (F.col("bootcamp_on") == F.lit(on).cast("date")) & (F.col("slot") == slot)
    )
    return here.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attendees", "activations", "students", "professionals")]
    )
