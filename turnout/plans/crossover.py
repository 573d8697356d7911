"""Leaders in both tracks, and where they played in person."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import parse_filter_date, parse_filter_moment
from turnout.operators.overlap import member_flags
from turnout.operators.roster import ci_equals

LEADER = "leader_email_normalized"


def _moment(ts: datetime) -> Column:
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


@dataclass(frozen=True)
class CrossoverParams:
    """Whitelisted dimensions of the crossover; unset ones add no condition."""

    in_person_event_id: int
    virtual_event_id: int
    sheet_kind: str | None = None
    attendance_city: str | None = None
    session_on: date | None = None
    label_contains: str | None = None
    label: str | None = None  # exact; wins over label_contains
    in_person_from: datetime | None = None
    in_person_to: datetime | None = None
    in_person_regs: Mapping[str, str] = field(default_factory=dict)  # city / state / attendance_city
    round_ids: Sequence[int] = ()
    virtual_from: datetime | None = None
    virtual_to: datetime | None = None
    virtual_regs: Mapping[str, str] = field(default_factory=dict)  # city / state
    city_limit: int = 20

    @classmethod
    def from_request(cls, args: Mapping[str, str], in_person_event_id: int, virtual_event_id: int
                     ) -> CrossoverParams | None:
        """Parameters from request values; None when an event id is not a positive number."""
        def text(name: str) -> str | None:
            return (args.get(name) or "").strip() or None

        try:
            ip = int(text("in_person_event_id") or in_person_event_id)
            virtual = int(text("virtual_event_id") or virtual_event_id)
        except ValueError:
            return None
        if min(ip, virtual) < 1:
            return None
        kind = (text("sheet_kind") or "").lower()
        limit = text("city_limit") or "20"
        ids = (text("round_ids") or "").replace(",", " ").split()
        return cls(
            in_person_event_id=ip,
            virtual_event_id=virtual,
            sheet_kind=kind if kind in ("main", "warmup") else None,
            attendance_city=text("attendance_city"),
            session_on=parse_filter_date(args.get("session_on")),
            label_contains=text("label_contains"),
            label=(args["label"] or "").strip() if "label" in args else None,
            in_person_from=parse_filter_moment(args.get("in_person_from")),
            in_person_to=parse_filter_moment(args.get("in_person_to")),
            in_person_regs={c: text(f"in_person_{c}") for c in ("city", "state", "attendance_city")
                            if text(f"in_person_{c}")},
            round_ids=tuple(int(i) for i in ids if i.lstrip("-").isdigit()),
            virtual_from=parse_filter_moment(args.get("virtual_from")),
            virtual_to=parse_filter_moment(args.get("virtual_to")),
            virtual_regs={c: text(f"virtual_{c}") for c in ("city", "state") if text(f"virtual_{c}")},
            city_limit=int(limit) if limit.isdecimal() and int(limit) > 0 else 20,
        )

    def in_person_rows(self) -> Column:
        out = F.col("event_id") == self.in_person_event_id
        if self.sheet_kind:
            out = out & (F.col("sheet_kind") == self.sheet_kind)
        if self.attendance_city:
            out = out & ci_equals("attendance_city", self.attendance_city)
        if self.session_on is not None:
            out = out & (F.col("session_on") == F.lit(self.session_on))
        if self.label is not None:
            out = out & ci_equals("session_label", self.label)
        elif self.label_contains:
            out = out & F.lower(F.trim("session_label")).like(f"%{self.label_contains.lower()}%")
        if self.in_person_from is not None:
            out = out & (F.col("imported_at") >= _moment(self.in_person_from))
        if self.in_person_to is not None:
            out = out & (F.col("imported_at") <= _moment(self.in_person_to))
        return out

    def virtual_rows(self) -> Column:
        out = F.col("event_id") == self.virtual_event_id
        if self.round_ids:
            out = out & F.col("challenge_id").isin(*self.round_ids)
        if self.virtual_from is not None:
            out = out & (F.col("imported_at") >= _moment(self.virtual_from))
        if self.virtual_to is not None:
            out = out & (F.col("imported_at") <= _moment(self.virtual_to))
        return out


def _registered(subs: DataFrame, regs: DataFrame | None, event_id: int, where: Mapping[str, str]) -> DataFrame:
    if not where or regs is None:
        return subs
    wanted = F.col("event_id") == event_id
    for column, value in where.items():
        wanted = wanted & ci_equals(column, value)
    emails = regs.where(wanted).select(F.col("email_normalized").alias("_email")).distinct()
    return subs.join(emails, F.col(LEADER) == F.col("_email"), "left_semi")


def crossover(
    in_person: DataFrame, virtual: DataFrame, params: CrossoverParams,
    in_person_regs: DataFrame | None = None, virtual_regs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Counts of distinct leaders per track, and the top in-person cities of the leaders in both.

    A leader counts once, under the first city in alphabetical order; a leader with a blank
    city row is left out of the city list.
    """
    ip = _registered(in_person.where(params.in_person_rows()), in_person_regs,
                     params.in_person_event_id, params.in_person_regs)
    v = _registered(virtual.where(params.virtual_rows()), virtual_regs, params.virtual_event_id, params.virtual_regs)
    flags = member_flags({"ip": ip, "v": v}, LEADER)
    in_ip, in_v = F.col("in_ip"), F.col("in_v")
    counts = flags.agg(
        F.count_if(in_ip).alias("distinct_ip_leaders"),
        F.count_if(in_v).alias("distinct_v_leaders"),
        F.count_if(in_ip & in_v).alias("both_tracks"),
        F.count_if(in_ip & ~in_v).alias("ip_only"),
        F.count_if(in_v & ~in_ip).alias("v_only"),
    )
    city = F.trim("attendance_city")
    # Both sides meet in one aggregation per leader, so the city pick needs no join.
    sides = ip.select(LEADER, "attendance_city", F.lit(True).alias("_ip")).unionByName(
        v.select(LEADER, F.lit(None).cast("string").alias("attendance_city"), F.lit(False).alias("_ip"))
    ).where(F.col(LEADER).isNotNull())
    per_leader = sides.groupBy(LEADER).agg(
        F.max("_ip").alias("_in_ip"),
        F.max(~F.col("_ip")).alias("_in_v"),
        F.min_by(F.nullif(city, F.lit("")), F.when(F.col("_ip"), F.struct(
            F.lower(F.coalesce(city, F.lit(""))).alias("fold"), F.coalesce(city, F.lit("")).alias("raw")
        ))).alias("city"),
    )
    cities = (
        per_leader.where("_in_ip AND _in_v AND city IS NOT NULL")
        .groupBy(F.col("city").alias("attendance_city")).agg(F.count(F.lit(1)).alias("n_leaders"))
        .orderBy(F.desc("n_leaders"), "attendance_city").limit(params.city_limit)
    )
    return counts, cities
