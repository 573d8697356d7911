"""Sessions and rounds: option lists, default picks, RSVP counts, eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.classify import RSVP_BUCKETS
from turnout.functions.text import coalesce_label, scope_key, session_display
from turnout.operators.counts import counts_not_after, last_n_days
from turnout.operators.dedupe import keep_first, latest_per_key


def session_options(sessions: DataFrame, subs: DataFrame) -> DataFrame:
    """Sessions with the number of main-sheet teams of the same event, newest first."""
    teams = (
        subs.where("sheet_kind = 'main'")
        .groupBy(
            F.col("event_id").alias("_event"),
            F.lower(F.trim("attendance_city")).alias("_city"),
            F.col("session_on").alias("_on"),
            F.coalesce("session_label", F.lit("")).alias("_label"),
        )
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    match = (
        (F.col("event_id") == F.col("_event"))
        & (F.lower(F.trim("city")) == F.col("_city"))
        & (F.col("session_on") == F.col("_on"))
        & (F.coalesce("session_label", F.lit("")) == F.col("_label"))
    )
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return (
        sessions.join(teams, match, "left")
        .select(*sessions.columns, n.alias("team_count"), (n > 0).alias("has_data"))
        .orderBy(F.desc("session_on"), "city", "session_label")
    )


def default_session(options: DataFrame, on: str, today: date, row_id: str, size: str | None = None) -> DataFrame:
    """One row: the latest session up to ``today``, else the earliest later one.

    Ties go to the larger ``size``, then to the larger id.
    """
    day = F.coalesce(F.col(on), F.lit("0001-01-01").cast("date"))
    past = day <= F.lit(today)
    distance = F.when(past, -F.datediff(day, F.lit(today))).otherwise(F.datediff(day, F.lit(today)))
    bigger = [F.desc(size)] if size else []
    return options.orderBy(past.desc(), distance.asc(), *bigger, F.desc(row_id)).limit(1)


def session_list(regs: DataFrame, subs: DataFrame, cap: int | None = None) -> DataFrame:
    """Dated sessions named by registrations, then those only submissions name; all or the first ``cap``."""
    named = regs.where("session_on IS NOT NULL").select(
        coalesce_label("attendance_city", "city", default="(Unknown)").alias("city"),
        "session_on",
        F.trim(F.coalesce("session_label", F.lit(""))).alias("session_label"),
        F.lit(0).alias("_source"),
    ).distinct()
    played = subs.where("sheet_kind = 'main' AND session_on IS NOT NULL AND trim(attendance_city) <> ''").select(
        F.trim("attendance_city").alias("city"),
        "session_on",
        F.trim(F.coalesce("session_label", F.lit(""))).alias("session_label"),
        F.lit(1).alias("_source"),
    ).distinct()
    keyed = named.unionByName(played).withColumn("scope_key", scope_key("city", "session_on", "session_label"))
    first = keep_first(keyed, ["scope_key"], ["_source", "city"]).drop("_source")
    ordered = first.withColumn("display", session_display("city", "session_on", "session_label")).orderBy(
        "session_on", F.lower("city"), "session_label", "city")
    return ordered if cap is None else ordered.limit(cap)


def rsvp_overlay(sessions: DataFrame, manual: DataFrame, snapshots: DataFrame) -> DataFrame:
    """RSVP counts per session: imported lists where they have rows, else the latest snapshot."""
    lists = manual.groupBy(F.col("session_id").alias("_sid")).agg(
        F.count_if(F.col("list_kind") == "invite_sent").alias("_sent"),
        F.count_if(F.col("list_kind") == "accepted").alias("_accepted"),
    )
    latest = latest_per_key(
        snapshots.select("scope_key", "fetched_at", "id", "rsvp_invite_sent", "rsvp_accepted"),
        ["scope_key"],
        ["fetched_at", "id"],
    ).select(F.col("scope_key").alias("_scope"), "rsvp_invite_sent", "rsvp_accepted")

    def chosen(own: str, other: str) -> Column:
        return F.when(F.col(own) > 0, F.col(own)).otherwise(F.coalesce(other, F.lit(0))).cast("long")

    return (
        sessions.join(lists, F.col("session_id") == F.col("_sid"), "left")
        .join(latest, F.col("scope_key") == F.col("_scope"), "left")
        .select(
            *sessions.columns,
            chosen("_sent", "rsvp_invite_sent").alias("rsvp_sent"),
            chosen("_accepted", "rsvp_accepted").alias("rsvp_accepted"),
        )
    )


def session_list_with_rsvp(
    regs: DataFrame, subs: DataFrame, manual: DataFrame, snapshots: DataFrame, cap: int | None = None
) -> DataFrame:
    """The session list with the RSVP counts of each session, in list order.

    ``manual`` has one row an imported address with its session's natural key (city, session_on, session_label) and ``list_kind``; snapshots are
    matched by scope key.  Sessions without either have zeros.
    """
    listed = session_list(regs, subs, cap).withColumn("session_id", F.col("scope_key"))
    lists = manual.select(scope_key("city", "session_on", F.trim(F.coalesce("session_label", F.lit("")))).alias("session_id"), "list_kind")
    return rsvp_overlay(listed, lists, snapshots).drop("session_id").orderBy("session_on", F.lower("city"), "session_label", "city")


def latest_snapshots(scopes: DataFrame, mappings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every scope with its mapping (the last one, if it has several) and latest snapshot, where present."""
    latest = latest_per_key(snapshots, ["scope_key"], ["fetched_at", "id"])
    latest = latest.select(
        F.col("scope_key").alias("_scope"), "rsvp_invite_sent", "rsvp_accepted", "checked_in_participants", "fetched_at"
    )
    named = mappings.groupBy(F.col("scope_key").alias("_mapped")).agg(F.max("external_key").alias("external_key"))
    return (
        scopes.join(named, F.col("scope_key") == F.col("_mapped"), "left")
        .join(latest, F.col("scope_key") == F.col("_scope"), "left")
        .drop("_mapped", "_scope")
    )


def event_snapshots(snapshots: DataFrame, event_id: str = "event_id") -> DataFrame:
    """The latest snapshot of every scope of every event."""
    return latest_per_key(snapshots, [event_id, "scope_key"], ["fetched_at", "id"])


def rsvp_buckets(members: DataFrame, email: str) -> DataFrame:
    """Strongest bucket per address from (list key, address) rows."""
    strength = F.lit(None).cast("int")
    for i, (_, key) in reversed(list(enumerate(RSVP_BUCKETS))):
        strength = F.when(F.col("list_key") == key, i).otherwise(strength)
    address = F.lower(F.trim(F.col(email)))
    best = (
        members.select(address.alias("email"), strength.alias("_s"))
        .where("email <> '' AND _s IS NOT NULL")
        .groupBy("email").agg(F.min("_s").alias("_s"))
    )
    names = F.array(*[F.lit(name) for name, _ in RSVP_BUCKETS])
    return best.select("email", F.get(names, F.col("_s")).alias("bucket"))


def round_order() -> list[Column]:
    """Live rounds first, then drafts, then the rest, by opening and id."""
    priority = F.when(F.col("status") == "live", 0).when(F.col("status") == "draft", 1).otherwise(2)
    return [priority.asc(), F.col("opens_at").asc_nulls_last(), F.col("id").asc()]


def pick_round(rounds: DataFrame, requested: int | None = None, configured: int | None = None) -> DataFrame:
    """One row: the requested round if it exists, else (when none was requested) the configured one, else the first."""
    wanted = requested if requested is not None else configured
    hit = F.coalesce(F.col("id") == F.lit(wanted), F.lit(False)) if wanted is not None else F.lit(False)
    return rounds.orderBy(hit.desc(), *round_order()).limit(1)


def round_counts(rounds: DataFrame, regs: DataFrame) -> DataFrame:
    """Rounds with their event's registrations at open and at close; NULL where the bound is not set."""
    bounds = rounds.select("event_id", F.col("opens_at").alias("_at")).unionByName(
        rounds.select("event_id", F.col("closes_at").alias("_at")))
    counted = counts_not_after(regs, "form_timestamp", bounds, "_at", "_n", ["event_id"])
    at_open = counted.select(F.col("event_id").alias("_oe"), F.col("_at").alias("_o"), F.col("_n").alias("registrations_at_open"))
    at_close = counted.select(F.col("event_id").alias("_ce"), F.col("_at").alias("_c"), F.col("_n").alias("registrations_at_close"))
    return (
        rounds.join(at_open, (F.col("opens_at") == F.col("_o")) & F.col("event_id").eqNullSafe(F.col("_oe")), "left")
        .join(at_close, (F.col("closes_at") == F.col("_c")) & F.col("event_id").eqNullSafe(F.col("_ce")), "left")
        .drop("_o", "_c", "_oe", "_ce")
    )


def eligibility_summary(regs: DataFrame, closes_at: Column, as_of: datetime) -> DataFrame:
    """One row: registrants, those registered by the close, and those of the last seven days among them."""
    when = F.col("form_timestamp")
    eligible = when <= closes_at
    return regs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(eligible, 1)).alias("eligible"),
        F.count(F.when(eligible & last_n_days(when, as_of), 1)).alias("eligible_last_7_days"),
    )


def eligible_members(
    members: DataFrame, regs: DataFrame, rounds: DataFrame, programmes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``members`` (e-mail and round) with ``eligible``: registered for the round's event, which is a virtual
    programme, no later than the round's close.

    Only the first registration of an address for an event matters, so no range join is needed.
    """
    first = regs.where("form_timestamp IS NOT NULL").groupBy(
        F.col("event_id").alias("_reg_event"), F.col("email_normalized").alias("_reg_email")
    ).agg(F.min("form_timestamp").alias("_reg_first"))
    virtual = programmes.where("kind = 'virtual'").select(F.col("id").alias("_virtual")).distinct()
    close = rounds.join(virtual, F.col("event_id") == F.col("_virtual"), "left_semi").select(
        F.col("id").alias("_close_round"), F.col("event_id").alias("_close_event"), F.col("closes_at").alias("_close_at"))
    email, round_id = keys
    return (
        members.join(close, F.col(round_id) == F.col("_close_round"), "left")
        .join(first, (F.col(email) == F.col("_reg_email")) & (F.col("_close_event") == F.col("_reg_event")), "left")
        .withColumn("eligible", F.coalesce(F.col("_reg_first") <= F.col("_close_at"), F.lit(False)))
        .drop("_reg_event", "_reg_email", "_reg_first", "_close_round", "_close_event", "_close_at")
    )
