"""JSON payloads: locating the record list, mapping records, RSVP snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import parse_date_text, parse_timestamp_text
from turnout.functions.text import as_col, split_trailing_years, strip_all
from turnout.session import pinned

# Keys under which a payload may hold its record list, envelope and header row.
LIST_KEYS = ("data", "registrations", "results", "items", "records", "rows", "users", "participants")
NESTED_LIST_KEYS = ("registrations", "data", "results", "items", "records", "rows", "users", "participants")
ENVELOPE_KEYS = ("data", "result", "response", "payload", "body", "event")
HEADER_KEYS = ("columns", "headers", "fields", "keys", "schema")


def _once(c: Column) -> Column:
    """Not deterministic in Spark's eyes, so that a long expression is not written out again wherever its column is used."""
    return F.when(F.spark_partition_id() >= 0, c)


def map_last_wins(entries: Column) -> Column:
    """Map from (key, value) entries; of equal keys the last one stays."""
    def later(kept: Column, e: Column) -> Column:
        return F.concat(F.filter(kept, lambda k: k["key"] != e["key"]), F.array(e))

    def made(e: Column) -> Column:
        keys = F.transform(e, lambda x: x["key"])
        unique = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.map_from_entries(F.when(unique, e).otherwise(F.reduce(e, F.slice(e, 1, 0), later)))

    return F.get(F.transform(F.array(entries), made), F.lit(0))


def _listed(words: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


_OBJECT = "map<string,variant>"
_SCALAR = "NOT rlike(schema_of_variant(x), '^(OBJECT|ARRAY|VOID)')"

#: The payload's top (base 0) and the envelopes it has, each read once as a map.
_ROOTS = f"""filter(transform(sequence(0, {len(ENVELOPE_KEYS)}), i -> named_struct('base', i, 'm',
    if(i = 0, _top, try_variant_get(try_element_at(_top, get({_listed(ENVELOPE_KEYS)}, i - 1)), '$', '{_OBJECT}')))), r -> r.m IS NOT NULL)"""

#: Per root, the first usable header row: a list of scalars that is not empty.
_HEADS = f"""map_from_entries(filter(transform(_roots, r -> struct(r.base, get(filter(
    transform(filter({_listed(HEADER_KEYS)}, k -> map_contains_key(r.m, k)), k -> try_variant_get(r.m[k], '$', 'array<variant>')),
    h -> size(h) > 0 AND forall(h, x -> {_SCALAR})), 0) AS head)), h -> h.head IS NOT NULL))"""

#: The lists under the keys that a root has: their root, key and items.
_LISTS = f"""flatten(transform(_roots, r -> filter(transform(filter({_listed(LIST_KEYS)}, k -> map_contains_key(r.m, k)),
    k -> named_struct('base', r.base, 'k', k, 'items', try_variant_get(r.m[k], '$', 'array<variant>'))), s -> s.items IS NOT NULL)))"""

_IS_OBJECT = f"try_variant_get(x, '$', '{_OBJECT}') IS NOT NULL"
_LEAD = "try_variant_get(get(s.items, 0), '$', 'array<variant>')"
_TABLES = "size(filter(s.items, x -> try_variant_get(x, '$', 'array<variant>') IS NOT NULL))"

#: Turns of a list as records and as a table: the top list, the top's keys, each envelope (lists, then tables), tables at the top; NULL where it holds none.
_AS_LIST = f"""if(exists(s.items, x -> {_IS_OBJECT}), CASE WHEN s.k = '' THEN 0 WHEN s.base = 0 THEN array_position({_listed(LIST_KEYS)}, s.k)
    ELSE s.base * 100 + array_position({_listed(NESTED_LIST_KEYS)}, s.k) END, NULL)"""
_AS_TABLE = f"""if(s.k <> '' AND {_LEAD} IS NOT NULL AND if(try_element_at(_heads, s.base) IS NOT NULL, {_TABLES} > 0,
    {_TABLES} > 1 AND forall({_LEAD}, x -> {_SCALAR})), if(s.base = 0, 1000, s.base * 100 + 50) + array_position({_listed(LIST_KEYS)}, s.k), NULL)"""
_TURNS = f"transform(_lists, s -> named_struct('list', {_AS_LIST}, 'tab', {_AS_TABLE}, 's', s))"


def _texts(items: Column) -> Column:
    return F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))


def tabular_json_to_rows(rows: Column, header: Column) -> Column:
    """Records of a list of lists; without a separate header the first row is one."""
    lists = F.filter(F.transform(rows, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda r: r.isNotNull())
    names = F.coalesce(header, _texts(F.get(lists, F.lit(0))))
    body = F.slice(lists, F.when(header.isNull(), 2).otherwise(1), F.greatest(F.size(rows), F.lit(1)))

    def records(names: Column) -> Column:
        def record(row: Column) -> Column:
            width = F.least(F.size(names), F.size(row))
            return map_last_wins(F.arrays_zip(
                F.slice(names, F.lit(1), width).alias("key"), F.slice(_texts(row), F.lit(1), width).alias("value")
            ))

        return F.transform(body, record)

    return F.get(F.transform(F.array(names), records), F.lit(0))


def locate_records(payloads: DataFrame, column: str) -> DataFrame:
    """The payloads' other columns with ``records`` (array of text maps, NULL where none were found) and ``unknown``.

    Looked for in order: a top-level list, the list keys, each envelope (lists, then tables), a table at the top.  A list
    without objects is an empty result, not an unknown shape.  A payload is parsed once and its keys are read once; only lists under
    keys that it has are looked into, each once.  One parse serves records and rejects alike, so a caller
    that wants both should persist this.  Parsing is heavy on the processor: few large files are better dealt out
    (``payloads.repartition(n)``) before they come here.
    """
    rest = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_v", _once(F.try_parse_json(column)))
    parsed = parsed.withColumn("_top", _once(F.expr(f"try_variant_get(_v, '$', '{_OBJECT}')")))
    rooted = parsed.withColumn("_roots", _once(F.expr(_ROOTS)))
    headed = rooted.withColumn("_heads", _once(F.expr(_HEADS)))
    top = "try_variant_get(_v, '$', 'array<variant>')"
    listed = headed.withColumn("_lists", _once(F.expr(f"if(_top IS NULL, filter(array(named_struct('base', 0, 'k', '', 'items', {top})), s -> s.items IS NOT NULL), {_LISTS})")))
    turned = listed.withColumn("_turns", _once(F.expr(_TURNS)))
    first = "array_min(transform(_turns, t -> least(t.list, t.tab)))"
    found = turned.withColumn("_pick", _once(F.expr(f"get(transform(array({first}), n -> get(filter(_turns, t -> least(t.list, t.tab) = n), 0)), 0)")))
    items = F.col("_pick.s.items")
    objects = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "map<string,string>")), lambda m: m.isNotNull())
    tables = tabular_json_to_rows(items, _texts(F.try_element_at("_heads", F.col("_pick.s.base"))))
    # A list that is empty, or any list under a key at the top, is a known shape.
    known = F.expr("exists(_lists, s -> s.base = 0 AND (s.k <> '' OR size(s.items) = 0))")
    as_table = F.expr("_pick.list IS NULL OR _pick.tab < _pick.list")
    return found.select(
        *rest, F.when(F.col("_pick").isNotNull(), _once(F.when(as_table, tables).otherwise(objects))).alias("records"),
        (F.col("_pick").isNull() & ~F.coalesce(known, F.lit(False))).alias("unknown"), column
    )


def located_records(located: DataFrame, column: str) -> DataFrame:
    """One row per record: the payload's columns, ``record_no`` and ``record``."""
    rest = [c for c in located.columns if c not in ("records", "unknown", column)]
    return located.select(*rest, F.posexplode("records").alias("record_no", "record"))


def extract_records_json(payloads: DataFrame, column: str, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per record of JSON payloads of unknown shape, and the payloads that hold no list at all.

    A caller that wants ``both`` has the payloads parsed once, to a table in the shared folder.
    """
    located = locate_records(payloads, column)
    located = pinned(located) if both else located
    return located_records(located, column), located.where("unknown").select(*payloads.columns)


def record_key(k: Column) -> Column:
    return F.translate(F.lower(strip_all(k)), " -/", "___")


def normalised_record(record: Column | str) -> Column:
    """Record with keys stripped, lower-cased, separators as underscores."""
    entries = F.transform(
        F.map_entries(as_col(record)), lambda e: F.struct(record_key(e["key"]).alias("key"), e["value"].alias("value"))
    )
    return map_last_wins(entries)


# Names a registration field may have in a record, in order of preference.
RECORD_ALIASES = {
    "email": ("email", "e_mail", "mail", "email_address", "user_email"),
    "form_timestamp": ("timestamp", "form_timestamp", "created_at", "registered_at", "submitted_at",
                       "registration_date"),
    "utm_source": ("utm_source", "utmsource"),
    "utm_medium": ("utm_medium", "utmmedium"),
    "utm_campaign": ("utm_campaign", "utmcampaign"),
    "utm_term": ("utm_term", "utmterm"),
    "utm_content": ("utm_content", "utmcontent"),
    "org_name": ("org_name", "college_school_company_startup_name", "organization", "company", "institute"),
    "org_state": ("org_state", "college_school_state", "organization_state"),
    "org_city": ("org_city", "college_school_city", "organization_city"),
    "class_stream": ("class_stream",),
    "portfolio": ("portfolio",),
    "domain": ("domain",),
    "designation": ("designation", "designation_year_of_exp", "designation_(year_of_exp.)",
                    "designation_years_experience"),
    "founded_info": ("founded_info", "founded_in_(startup_size)", "founded_in"),
    "degree": ("degree", "degree_(passout_year)"),
    "profile_name": ("profile_name", "profilename"),
    "full_name": ("full_name", "fullname", "name", "participant_name"),
    "mobile": ("mobile", "mobile_number", "phone", "phone_number"),
    "whatsapp": ("whatsapp", "whatsapp_number"),
    "country": ("country",),
    "state": ("state", "state_province"),
    "city": ("city", "city_residence"),
    "dob": ("dob", "date_of_birth", "dateofbirth", "birth_date", "birthdate"),
    "gender": ("gender",),
    "occupation": ("occupation",),
    "github_url": ("github_url", "github", "githubprofile"),
    "linkedin_url": ("linkedin_url", "linkedin", "linkedinprofile"),
    "attendance_city": ("attendance_city", "preferred_city"),
}


def first_alias(record: str, names: Sequence[str]) -> Column:
    """First value among the names in a map of stripped values that are not blank."""
    return F.expr("coalesce(" + ", ".join(f"try_element_at({record}, '{n}')" for n in names) + ")")


def map_registration_records(records: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Typed registration rows, and the records without an e-mail with the reason.

    A record becomes one map of normalised keys to stripped values without blanks, made once and read by every field.
    """
    stripped = F.transform_values(normalised_record(record), lambda _, v: strip_all(v))
    keyed = records.withColumn("_m", _once(F.map_filter(stripped, lambda _, v: v != "")))
    fields = {name: first_alias("_m", names) for name, names in RECORD_ALIASES.items()}
    # The attendance question is matched by its start, as in files.
    question = F.map_values(F.map_filter("_m", lambda k, _: k.startswith("in_which_city,_would_you_like_to_attend")))
    fields["attendance_city"] = F.coalesce(fields["attendance_city"], F.get(question, F.lit(0)))
    rest = [c for c in records.columns if c != record]
    flat = keyed.select(*rest, record, *[c.alias(n) for n, c in fields.items()])
    designation, years = split_trailing_years("designation")
    special = {
        "form_timestamp": parse_timestamp_text("form_timestamp"),
        "dob": parse_date_text("dob"),
        "designation": designation,
    }
    rows = flat.where("email IS NOT NULL").select(
        *rest, *[special.get(n, F.col(n)).alias(n) for n in fields], years.alias("designation_years")
    )
    rejects = flat.where("email IS NULL").select(*rest, record, F.lit("missing email").alias("reason"))
    return rows, rejects


SNAPSHOT_SCHEMA = (
    "event struct<eventId:string, eventTag:string, eventName:string>, "
    "stats struct<rsvpInviteSent:int, rsvpAccepted:int, checkedInParticipants:int>, "
    "statsEmails map<string, array<string>>"
)


def parse_rsvp_snapshot(payloads: DataFrame, column: str) -> DataFrame:
    """RSVP snapshot columns of a payload; the e-mail lists stay a map of bucket key to addresses."""
    parsed = payloads.withColumn("_p", F.from_json(column, SNAPSHOT_SCHEMA))
    p = F.col("_p")
    return parsed.select(
        *[c for c in payloads.columns if c != column],
        p["event"]["eventId"].alias("external_event_id"),
        p["event"]["eventTag"].alias("external_event_tag"),
        p["event"]["eventName"].alias("external_event_name"),
        p["stats"]["rsvpInviteSent"].alias("rsvp_invite_sent"),
        p["stats"]["rsvpAccepted"].alias("rsvp_accepted"),
        p["stats"]["checkedInParticipants"].alias("checked_in_participants"),
        p["statsEmails"].alias("stats_emails"),
    )


def payload_digest(payload: Column | str) -> Column:
    return F.substring(F.sha2(as_col(payload), 256), 1, 32)
