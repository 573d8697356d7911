"""Workbook tabs: one CSV per tab, routed by its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.text import as_col, collapse_spaces, normalise_key

# Tab names of a session workbook.
WARMUP_TABS = (
    "warm up challenge",
    "warmup challenge",
    "warm-up challenge",
    "warmup round app submission",
    "warm up round app submission",
    "warm-up round app submission",
)
MAIN_TABS = ("main challenge submission", "main challenge")


def strip_enumerator(tab: Column | str) -> Column:
    """Tab name without a leading ``1.`` or ``2)``."""
    return F.regexp_replace(collapse_spaces(tab), r"^\s*\d+[.)]\s*", "")


def round_suffix(tab: Column | str) -> Column:
    """Normalised text after ``Submission``; NULL for other tabs."""
    found = F.regexp_extract(normalise_key(strip_enumerator(tab)), r"^submission\s+(.+)$", 1)
    return F.nullif(found, F.lit(""))


def sheet_kind(tab: Column | str) -> Column:
    """``warmup``, ``main`` or NULL."""
    key = normalise_key(strip_enumerator(tab))
    return (
        F.when(key.isin(*WARMUP_TABS), "warmup")
        .when(key.isin(*MAIN_TABS) | key.rlike(r"^challenge \d+ submission$"), "main")
    )


def round_keys(rounds: DataFrame) -> DataFrame:
    """(key, round id): the import suffix of a round, else its title."""
    own = F.nullif(F.trim(F.coalesce("import_sheet_suffix", F.lit(""))), F.lit(""))
    return rounds.select(normalise_key(F.coalesce(own, F.col("title"))).alias("key"), F.col("id").alias("challenge_id"))


def colliding_keys(rounds: DataFrame) -> DataFrame:
    """Keys shared by several rounds."""
    return round_keys(rounds).groupBy("key").agg(
        F.count_distinct("challenge_id").alias("n_rounds")
    ).where("n_rounds > 1")


def route_tabs_to_rounds(tabs: DataFrame, tab: str, rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tabs with their round id, and the tabs without one with the reason."""
    keyed = tabs.withColumn("_suffix", round_suffix(as_col(tab)))
    shared = colliding_keys(rounds).select(F.col("key").alias("_shared"))
    usable = round_keys(rounds).join(shared, F.col("key") == F.col("_shared"), "left_anti")
    joined = keyed.join(usable, F.col("_suffix") == F.col("key"), "left").join(
        shared, F.col("_suffix") == F.col("_shared"), "left"
    )
    reason = (
        F.when(F.col("_suffix").isNull(), "not a submission tab")
        .when(F.col("_shared").isNotNull(), "several rounds share this key")
        .when(F.col("challenge_id").isNull(), "no round matches")
    )
    checked = joined.withColumn("reason", reason).drop("_suffix", "key", "_shared")
    return (
        checked.where("reason IS NULL").drop("reason"),
        checked.where("reason IS NOT NULL").drop("challenge_id"),
    )


def route_tabs_to_kind(tabs: DataFrame, tab: str) -> tuple[DataFrame, DataFrame]:
    """Tabs with their sheet kind, and the unknown or repeated tabs with the reason."""
    kinds = tabs.select(tab).distinct().withColumn("sheet_kind", sheet_kind(tab))
    repeated = kinds.where("sheet_kind IS NOT NULL").groupBy(F.col("sheet_kind").alias("_kind")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    checked = kinds.join(repeated, F.col("sheet_kind") == F.col("_kind"), "left").withColumn(
        "reason",
        F.when(F.col("sheet_kind").isNull(), "unknown tab").when(F.col("_n") > 1, "several tabs of this kind"),
    )
    bad = checked.where("reason IS NOT NULL").select(tab, "reason")
    good = checked.where("reason IS NULL").select(F.col(tab).alias("_tab"), "sheet_kind")
    return tabs.join(good, F.col(tab) == F.col("_tab")).drop("_tab"), bad
