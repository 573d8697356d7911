"""Batch credit grants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.numbers import MONEY
from turnout.functions.text import normalise_email
from turnout.operators.merge import upsert
from turnout.operators.sessions import eligible_members
from turnout.session import pinned


#: Why a grant is refused.  The text of NOT_ELIGIBLE is a fixed value, the others are codes of this library.
INCOMPLETE, DUPLICATE, NO_TARGET = "incomplete", "duplicate", "no_target"
UNKNOWN_ROUND, UNKNOWN_PROGRAMME, NOT_VIRTUAL = "unknown_round", "unknown_programme", "not_virtual"
NOT_ELIGIBLE = "participant ineligible for challenge"


@dataclass(frozen=True)
class Granted:
    tagged: DataFrame  # every grant with reason_rejected (NULL if accepted); the others are filters on it
    ledger: DataFrame  # rows to append
    balances: DataFrame  # balances after the batch, with _action
    rejects: DataFrame  # refused grants, with a reason


def grant_credits(
    grants: DataFrame, ledger: DataFrame, balances: DataFrame, rounds: DataFrame, programmes: DataFrame,
    participants: DataFrame, regs: DataFrame,
) -> Granted:
    """Apply a batch of grants.

    A grant without participant, amount or reason is incomplete.  Next, it is a duplicate when its idempotency key
    was used, in the ledger or by an accepted grant before it; this goes before all other checks.  Then its round or
    programme must exist and be virtual, and the participant must have registered for the round's event by its
    close unless ``force`` is set.  ``row_no`` orders the batch.

    The judged batch is pinned, first before and then after the look at used keys, so that registrations, ledger and batch are each scanned once and the three
    results are filters on what is pinned.
    """
    incomplete = (
        F.col("participant_id").isNull() | F.col("delta").isNull() | (F.coalesce("reason", F.lit("")) == "")
    )
    known = rounds.select(F.col("id").alias("_round"), F.col("event_id").alias("_round_event"))
    kinds = programmes.select(F.col("id").alias("_programme"), F.col("kind").alias("_kind"))
    emails = participants.select(F.col("id").alias("_pid"), normalise_email("email").alias("_email"))
    scoped = (
        grants.join(known, F.col("challenge_id") == F.col("_round"), "left")
        .join(kinds, F.col("event_id") == F.col("_programme"), "left")
        .join(emails, F.col("participant_id") == F.col("_pid"), "left")
        .withColumn("_scope", F.when(F.col("challenge_id").isNotNull(), F.col("_round_event")).otherwise(
            F.when(F.col("_kind") == "virtual", F.col("_programme"))
        ))
    )
    gated = eligible_members(scoped, regs, rounds, programmes, ("_email", "challenge_id"))
    needs_gate = F.col("challenge_id").isNotNull() & ~F.col("eligible")
    forced = F.coalesce("force", F.lit(False))
    checked = pinned(gated.withColumn(
        "_own",
        F.when(incomplete, INCOMPLETE)
        .when(F.col("challenge_id").isNull() & F.col("event_id").isNull(), NO_TARGET)
        .when(F.col("challenge_id").isNotNull() & F.col("_round").isNull(), UNKNOWN_ROUND)
        .when(F.col("challenge_id").isNull() & F.col("_programme").isNull(), UNKNOWN_PROGRAMME)
        .when(F.col("_scope").isNull(), NOT_VIRTUAL)
        .when(needs_gate & ~forced, NOT_ELIGIBLE),
    ).withColumn("force_ineligible", needs_gate & forced).select(*grants.columns, "_own", "force_ineligible", "_scope"))
    # A key in the ledger is used before any row; of the batch, the first acceptable grant of a key uses it and what comes later is a duplicate.
    keys = ledger.select("idempotency_key", F.lit(True).alias("_old"), F.lit(None).cast(grants.schema["row_no"].dataType).alias("_at")).unionAll(
        checked.where("_own IS NULL").select("idempotency_key", F.lit(False), "row_no")).where("idempotency_key IS NOT NULL")
    used = keys.groupBy(F.col("idempotency_key").alias("_key")).agg(F.max("_old").alias("_seen"), F.min("_at").alias("_used_at"))
    late = F.coalesce(F.col("_seen") | (F.col("row_no") > F.col("_used_at")), F.lit(False)) & ~incomplete
    tagged = pinned(checked.join(used, F.col("idempotency_key") == F.col("_key"), "left").withColumn(
        "reason_rejected", F.when(late, DUPLICATE).otherwise(F.col("_own"))
    ).select(*grants.columns, "reason_rejected", "force_ineligible", "_scope"))
    rejects = tagged.where("reason_rejected IS NOT NULL").select(*grants.columns, "reason_rejected")
    rows = tagged.where("reason_rejected IS NULL").select(
        "participant_id", "challenge_id", F.col("delta").cast(MONEY).alias("delta"), "reason", "idempotency_key",
        "force_ineligible", F.col("_scope").alias("event_id"),
    )
    deltas = rows.groupBy("participant_id", "event_id").agg(F.sum("delta").alias("balance"))
    merged = upsert(balances, deltas, ["participant_id", "event_id"], additive=["balance"])
    return Granted(tagged, rows, merged, rejects)
