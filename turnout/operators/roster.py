"""The faceted registrant roster: filters, best score, sort, pages, participation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.numbers import at_least_one
from turnout.functions.classify import SEGMENTS, attempt_bucket, segment_case
from turnout.functions.dates import parse_filter_date, parse_filter_moment
from turnout.operators.ordering import page_count, ranked_page

#: Columns that may be filtered by exact value.
FACET_COLUMNS = (
    "org_name", "org_state", "org_city", "class_stream", "portfolio", "domain", "designation", "founded_info",
    "degree", "country", "state", "city", "gender", "occupation", "github_url", "linkedin_url", "attendance_city",
)

SEARCH_COLUMNS = ("email", "full_name", "profile_name", "mobile")


def ci_equals(column: Column | str, value: str) -> Column:
    """Case-insensitive, space-trimmed equality; NULL counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(F.coalesce(c, F.lit("")))) == value.strip(" ").lower()


def text_search(columns: Sequence[str], text: str) -> Column:
    """Any column contains ``text``, ignoring case.  ``%`` and ``_`` act as wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{text}%")
    return found


@dataclass(frozen=True)
class RosterFilter:
    """What a roster request asks for; unset fields add no condition."""

    facets: Mapping[str, str] = field(default_factory=dict)
    search: str = ""
    attendance_city: str | None = None
    session_on: date | None = None
    session_label: str = ""
    registered_from: datetime | None = None
    registered_to: datetime | None = None
    born_from: date | None = None
    born_to: date | None = None
    years_min: int | None = None
    years_max: int | None = None
    eligible_until: datetime | None = None
    participated_round: int | None = None
    segment_round: int | None = None
    segment: str | None = None
    attempts: int | None = None

    @classmethod
    def from_request(cls, args: Mapping[str, str]) -> RosterFilter:
        """Whitelisted request values; invalid ones are ignored."""
        def text(name: str) -> str:
            return (args.get(name) or "").strip()

        def digits(name: str) -> int | None:
            raw = text(name)
            return int(raw) if raw.isdecimal() and raw.isascii() else None

        def years(name: str) -> int | None:
            n = digits(name)
            return n if n is not None and n <= 99 else None

        low, high = years("designation_years_min"), years("designation_years_max")
        if low is not None and high is not None and low > high:
            low, high = high, low
        segment = text("segment").lower()
        attempts = digits("attempts")
        return cls(
            facets={c: text(f"af_{c}") for c in FACET_COLUMNS if text(f"af_{c}")},
            search=text("q"),
            attendance_city=text("attendance_city") or None,
            registered_from=parse_filter_moment(args.get("form_ts_from")),
            registered_to=parse_filter_moment(args.get("form_ts_to"), end=True),
            born_from=parse_filter_date(args.get("dob_from")),
            born_to=parse_filter_date(args.get("dob_to")),
            years_min=low,
            years_max=high,
            participated_round=digits("participated_round"),
            segment_round=digits("segment_round") if segment in SEGMENTS else None,
            segment=segment if segment in SEGMENTS else None,
            # Attempts narrow only the segments that have attempt charts.
            attempts=attempts if attempts is not None and attempts <= 99 and segment in SEGMENTS[:2] else None,
        )

    def predicate(self) -> Column:
        """The conditions on registration columns."""
        def moment(ts: datetime) -> Column:
            return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

        when = F.col("form_timestamp")
        parts: list[Column] = [ci_equals(c, v) for c, v in self.facets.items() if c in FACET_COLUMNS]
        if self.search:
            parts.append(text_search(SEARCH_COLUMNS, self.search))
        if self.attendance_city:
            parts.append(F.trim(F.coalesce("attendance_city", F.lit(""))) == self.attendance_city)
        if self.session_on is not None:
            parts.append(F.col("session_on") == F.lit(self.session_on))
        if self.session_label.strip():
            parts.append(ci_equals("session_label", self.session_label))
        if self.registered_from is not None:
            parts.append(when >= moment(self.registered_from))
        if self.registered_to is not None:
            parts.append(when <= moment(self.registered_to))
        if self.eligible_until is not None:
            parts.append(when <= moment(self.eligible_until))
        if self.born_from is not None:
            parts.append(F.col("dob") >= F.lit(self.born_from))
        if self.born_to is not None:
            parts.append(F.col("dob") <= F.lit(self.born_to))
        if self.years_min is not None:
            parts.append(F.col("designation_years") >= self.years_min)
        if self.years_max is not None:
            parts.append(F.col("designation_years") <= self.years_max)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def matching_registrations(subs: DataFrame, regs: DataFrame) -> DataFrame:
    """Distinct registration ids a submission belongs to, by link or by leader e-mail.

    An OR in one join condition would be a nested loop; these are two equi joins on
    distinct keys, united.
    """
    by_link = subs.select(F.col("registration_id").alias("id")).where("id IS NOT NULL")
    emails = subs.select(F.col("leader_email_normalized").alias("_email")).where("_email IS NOT NULL").distinct()
    by_email = regs.join(emails, F.col("email_normalized") == F.col("_email"), "left_semi").select("id")
    return by_link.unionByName(by_email).distinct()


def apply_filter(regs: DataFrame, spec: RosterFilter, subs: DataFrame | None = None, round_id: str = "challenge_id",
                 session: Column | None = None) -> DataFrame:
    """Registrations that satisfy the filter, including its submission conditions.

    ``session`` restricts submissions to one in-person session; participation and segments
    then refer to it instead of to a round.
    """
    out = regs.where(spec.predicate())
    if subs is None:
        return out
    if spec.participated_round is not None:
        hits = matching_registrations(subs.where(F.col(round_id) == spec.participated_round), regs)
        out = out.join(hits.withColumnRenamed("id", "_hit"), F.col("id") == F.col("_hit"), "left_semi")
    elif session is not None:
        emails = subs.where(session).select(F.col("leader_email_normalized").alias("_email")).distinct()
        out = out.join(emails, F.col("email_normalized") == F.col("_email"), "left_semi")
    scope = session if session is not None else (
        F.col(round_id) == spec.segment_round if spec.segment_round is not None else None
    )
    if spec.segment is None or scope is None:
        return out
    rows = subs.where(scope)
    if spec.segment == "unknown":
        emails = rows.where("registration_id IS NULL").select(F.col("leader_email_normalized").alias("_seg"))
        return out.join(emails.distinct(), F.col("email_normalized") == F.col("_seg"), "left_semi")
    if spec.attempts is not None:
        rows = rows.where(attempt_bucket("attempts_completed") == spec.attempts)
    linked = rows.select(F.col("registration_id").alias("_seg")).where("_seg IS NOT NULL").distinct()
    out = out.where(segment_case("occupation", "id") == spec.segment)
    return out.join(linked, F.col("id") == F.col("_seg"), "left_semi")


def best_score(regs: DataFrame, subs: DataFrame) -> DataFrame:
    """Registrations with ``submission_score``: best score of any submission linked by id or by e-mail.

    Submissions shrink to one row per key before either join, so a prolific leader costs one row.
    """
    ids = subs.where("registration_id IS NOT NULL").groupBy(F.col("registration_id").alias("_by_id")).agg(
        F.max("total_score").alias("_id_score")
    )
    emails = subs.where("leader_email_normalized IS NOT NULL").groupBy(
        F.col("leader_email_normalized").alias("_by_email")
    ).agg(F.max("total_score").alias("_email_score"))
    return (
        regs.join(ids, F.col("id") == F.col("_by_id"), "left")
        .join(emails, F.col("email_normalized") == F.col("_by_email"), "left")
        # greatest() skips NULLs
        .withColumn("submission_score", F.greatest("_id_score", "_email_score"))
        .drop("_by_id", "_id_score", "_by_email", "_email_score")
    )


def _folded(*names: str) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])))


def sort_columns(key: str | None, direction: str, mode: str = "virtual") -> list[Column]:
    """Allow-listed sort, newest registration first by default, ids descending as the tie-break."""
    keys = {
        "name": lambda: _folded("full_name"),
        "email": lambda: _folded("email"),
        "location": lambda: _folded("city", "state"),
        "occupation": lambda: _folded("occupation"),
        "designation": lambda: _folded("designation"),
        "yrs_exp": lambda: F.col("designation_years"),
        "registered": lambda: F.col("form_timestamp"),
    }
    if mode == "virtual":
        keys["score"] = lambda: F.col("submission_score")
    else:
        keys["attendance_city"] = lambda: _folded("attendance_city")
    if key not in keys:
        return [F.col("form_timestamp").desc_nulls_last(), F.col("id").desc()]
    column = keys[key]()
    first = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    return [first, F.col("id").desc()]


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    per_page: int
    pages: int


def roster_page(rows: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 50) -> Page:
    """One page of the roster with the total."""
    per_page, page = at_least_one(per_page, "per_page"), max(page, 1)
    total = rows.count()
    numbered = ranked_page(rows, order, per_page, (page - 1) * per_page, name="row")
    return Page(numbered, total, page, per_page, page_count(total, per_page))


def in_list(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose column is among the values; a list of any length is a semi join."""
    wanted = values.select(F.col(value).alias("_wanted")).where("_wanted IS NOT NULL").distinct()
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def registrant_submissions(regs: DataFrame, subs: DataFrame, sessions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For every registration that has any: its submissions with their sessions' names, as an array in list order."""
    held = sessions.select(F.col("id").alias("_sid"), F.col("event_id").alias("_sev"), "display")
    entry = F.struct(*[F.col(c) for c in ("sheet_kind", "team_name", "session_on", "id", *columns)], "display")
    linked = subs.where("registration_id IS NOT NULL").join(held, (F.col("session_id") == F.col("_sid")) & (F.col("event_id") == F.col("_sev")))
    lists = linked.groupBy(F.col("registration_id").alias("_rid"), F.col("event_id").alias("_rev")).agg(F.sort_array(F.collect_list(entry)).alias("submissions"))
    return regs.join(lists, (F.col("id") == F.col("_rid")) & (F.col("event_id") == F.col("_rev"))).drop("_rid", "_rev")


def participation(regs: DataFrame, ip_subs: DataFrame, v_subs: DataFrame, v_regs: DataFrame) -> DataFrame:
    """Per e-mail: distinct in-person sessions (registered or submitted) and distinct virtual rounds."""
    return participation_of(in_person_places(regs, ip_subs, ["session_id"]), v_subs, v_regs)


def in_person_places(regs: DataFrame, ip_subs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One frame of (registration_id, email_normalized, columns): registrations with their address, submissions with none."""
    none = F.lit(None).cast("string").alias("email_normalized")
    return regs.select(F.col("id").alias("registration_id"), "email_normalized", *columns).unionAll(
        ip_subs.where("registration_id IS NOT NULL").select("registration_id", none, *columns))


def participation_of(places: DataFrame, v_subs: DataFrame, v_regs: DataFrame) -> DataFrame:
    """As ``participation``, from ``in_person_places`` with their ``session_id``.

    Every row becomes a tagged fact of a registration: its address, or where the registration was.  One aggregation by
    registration gives its places the address, a second one counts them by address; no table is read twice and nothing is joined.  Submissions without a
    registration keep their own address and are dealt out by it.
    """
    def fact(track: str, key: Column, own: Column, direct: Column, what: Column) -> tuple[Column, ...]:
        place = F.when(what.isNotNull(), F.struct(direct.cast("string").alias("email"), what.cast("string").alias("what")))
        return (F.lit(track).alias("_track"), key.cast("string").alias("_key"), own.cast("string").alias("_own"), place.alias("_place"))

    none, what = F.lit(None).cast("string"), F.col("challenge_id")
    alone = F.concat(F.lit("@"), F.col("leader_email_normalized"))
    facts = places.select(*fact("s", F.col("registration_id"), F.col("email_normalized"), none, F.col("session_id")))
    facts = facts.unionAll(v_regs.select(*fact("r", F.col("id"), F.col("email_normalized"), none, F.lit(None))))
    facts = facts.unionAll(v_subs.where(what.isNotNull()).select(
        *fact("r", F.coalesce(F.col("registration_id").cast("string"), alone), none, F.col("leader_email_normalized"), what)))
    held = facts.where("_key IS NOT NULL").groupBy("_track", "_key").agg(F.max("_own").alias("_own"), F.collect_set("_place").alias("_places"))
    each = held.select("_track", "_own", F.explode("_places").alias("p"))
    addresses = F.array_distinct(F.filter(F.array("_own", "p.email"), lambda x: x.isNotNull()))
    pairs = each.select("_track", F.explode(addresses).alias("email_normalized"), F.col("p.what").alias("what")).distinct()
    return pairs.groupBy("email_normalized").agg(
        F.count_if(F.col("_track") == "s").alias("n_sessions"), F.count_if(F.col("_track") == "r").alias("n_rounds")
    )
