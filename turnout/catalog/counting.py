"""Dashboard metrics, facets, timelines, rosters and reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import AS_OF, day_text, query
from turnout.functions.text import coalesce_label, compact_number, initcap_words, scope_key, score_text
from turnout.operators.counts import (
    alias_rollup,
    counts_not_after,
    daily_counts,
    facet_values,
    hourly_counts,
    in_business_days,
    label_counts,
    options_with_extras,
    recent_daily_counts,
)
from turnout.operators.ordering import ranked_page
from turnout.operators.roster import RosterFilter, apply_filter, best_score, in_person_places, participation_of, sort_columns
from turnout.operators.sessions import eligibility_summary, pick_round, round_counts, round_order, session_list, session_list_with_rsvp
from turnout.plans.dashboard import (
    dashboard_labels,
    date_bounds,
    overview_counts,
    registration_brief,
    registration_totals,
    state_label,
    top_city_label,
)
from turnout.plans.reports import city_breakdown, export_rows, in_person_summary, round_summary, submission_counts

_AGE = """year(DATE '2001-01-15') - year(dob)
  - CASE WHEN strftime(DATE '2001-01-15', '%m%d') < strftime(dob, '%m%d') THEN 1 ELSE 0 END"""
_LAST7 = "form_timestamp >= TIMESTAMP '2001-01-08 12:00:00'"
# PostgreSQL-style capitalisation, written out for the values the tables hold.
_INITCAP = """array_to_string([upper(x[1]) || x[2:] for x in
  regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')], '')"""
_STATE = _INITCAP.format(c="nullif(trim(state, ' '), '')")
_IST = "(form_timestamp + INTERVAL 330 MINUTE)"


@query("""SELECT strftime(CAST(min(form_timestamp + INTERVAL 330 MINUTE) AS DATE), '%Y-%m-%d') AS date_min,
  strftime(CAST(max(form_timestamp + INTERVAL 330 MINUTE) AS DATE), '%Y-%m-%d') AS date_max FROM signups""", "signups")
def registration_date_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return date_bounds(base.signups(spark, folder)).select(day_text("date_min"), day_text("date_max"))


@query(f"""SELECT count(*) AS total, count(CASE WHEN trim(attendance_city, ' ') <> '' THEN 1 END) AS with_attendance_city,
  count(DISTINCT nullif(trim(country, ' '), '')) AS distinct_countries,
  count(DISTINCT nullif(trim(state, ' '), '')) AS distinct_states,
  strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_updated, round(avg({_AGE}), 1) AS average_age,
  count(dob) AS with_dob, count(CASE WHEN {_LAST7} THEN 1 END) AS last_7_days
  FROM (SELECT *, form_timestamp AS updated_at FROM regs)""", "regs")
def registration_totals_all(spark: SparkSession, folder: str) -> DataFrame:
    totals = registration_totals(base.registrations(spark, folder), AS_OF)
    return totals.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@query(f"""SELECT count(*) AS total, count(CASE WHEN {_LAST7} THEN 1 END) AS last_7_days,
  round(avg({_AGE}), 1) AS average_age,
  (SELECT coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), '')) AS l FROM regs
   GROUP BY 1 HAVING l IS NOT NULL ORDER BY count(*) DESC, l LIMIT 1) AS top_city,
  (SELECT {_STATE} AS l FROM regs GROUP BY 1 HAVING l IS NOT NULL ORDER BY count(*) DESC, l LIMIT 1) AS top_state
  FROM regs""", "regs")
def registration_brief_row(spark: SparkSession, folder: str) -> DataFrame:
    return registration_brief(base.registrations(spark, folder), AS_OF)


def _top_sql(label: str, n: int | None) -> str:
    tail = f" ORDER BY n DESC, label LIMIT {n}" if n else ""
    return f"SELECT label, n FROM (SELECT {label} AS label, count(*) AS n FROM regs GROUP BY 1) WHERE label IS NOT NULL{tail}"


@query(_top_sql("coalesce(nullif(trim(utm_source, ' '), ''), '(none)')", 8), "regs")
def label_counts_top8(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), coalesce_label("utm_source", default="(none)"), 8)


@query(_top_sql(_STATE, 1), "regs")
def top_state(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), state_label(), 1)


@query(_top_sql("nullif(trim(city, ' '), '')", 1), "regs")
def top_city_virtual(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), top_city_label("virtual"), 1)


@query(_top_sql("coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''))", 1), "regs")
def top_city_in_person(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), top_city_label("in_person"), 1)


@query(_top_sql(_STATE, 36), "regs")
def state_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), state_label(), 36)


@query(_top_sql("coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''), '(Unknown)')", 40), "regs")
def city_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(
        base.registrations(spark, folder), coalesce_label("attendance_city", "city", default="(Unknown)"), 40
    )


@query(_top_sql("coalesce(nullif(trim(gender, ' '), ''), '(unspecified)')", 8), "regs")
def gender_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), coalesce_label("gender", default="(unspecified)"), 8)


@query(_top_sql("coalesce(nullif(trim(occupation, ' '), ''), '(unspecified)')", 8), "regs")
def occupation_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), coalesce_label("occupation", default="(unspecified)"), 8)


@query(_top_sql("nullif(trim(attendance_city, ' '), '')", None), "regs")
def attendance_cities(spark: SparkSession, folder: str) -> DataFrame:
    return label_counts(base.registrations(spark, folder), F.nullif(F.trim("attendance_city"), F.lit("")))


@query(f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, count(s.id) AS n
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN signups s ON CAST({_IST} AS DATE) = d.day GROUP BY 1""", "signups")
def daily_timeline(spark: SparkSession, folder: str) -> DataFrame:
    days = daily_counts(base.signups(spark, folder), "form_timestamp", date(2023, 12, 30), date(2024, 2, 5))
    return days.select(day_text("day"), "n")


@query(f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, count(s.id) AS n
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-20' - INTERVAL 119 DAY, TIMESTAMP '2024-01-20',
    INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN signups s ON CAST({_IST} AS DATE) = d.day GROUP BY 1""", "signups")
def recent_timeline(spark: SparkSession, folder: str) -> DataFrame:
    days = recent_daily_counts(base.signups(spark, folder), "form_timestamp", date(2024, 1, 20))
    return days.select(day_text("day"), "n")


@query(f"""SELECT h.hour, count(s.id) AS n FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
  LEFT JOIN signups s ON hour({_IST}) = h.hour GROUP BY 1""", "signups")
def hourly_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_counts(base.signups(spark, folder), "form_timestamp")


@query(f"""SELECT count(CASE WHEN CAST({_IST} AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' THEN 1 END)
  AS in_range, count(CASE WHEN form_timestamp >= TIMESTAMP '2024-01-13 12:00:00' THEN 1 END) AS rolling
  FROM signups""", "signups")
def last7_days(spark: SparkSession, folder: str) -> DataFrame:
    from turnout.operators.counts import last_n_days

    return base.signups(spark, folder).agg(
        F.count(F.when(in_business_days("form_timestamp", date(2024, 1, 14), date(2024, 1, 20)), 1)).alias("in_range"),
        F.count(F.when(last_n_days("form_timestamp", datetime(2024, 1, 20, 12)), 1)).alias("rolling"),
    )


_FACETS = ("full_name", "occupation", "designation", "city", "state", "country", "attendance_city", "utm_source", "gender")


@query(", v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, trim({c}, ' ') AS value FROM regs" for c in _FACETS
) + """) SELECT facet, value FROM (SELECT DISTINCT facet, value FROM v WHERE value <> '')
""", "regs")
def facet_value_lists(spark: SparkSession, folder: str) -> DataFrame:
    return facet_values(base.registrations(spark, folder), _FACETS)


@query("""SELECT value FROM (SELECT DISTINCT trim(attendance_city, ' ') AS value FROM regs
  WHERE trim(attendance_city, ' ') <> '' UNION ALL SELECT 'Elsewhere')""", "regs")
def attendance_city_options(spark: SparkSession, folder: str) -> DataFrame:
    return options_with_extras(base.registrations(spark, folder), "attendance_city", ["nation_3", "Elsewhere"])


@query("""SELECT name, coalesce(sum(n), 0) AS value FROM (VALUES ('Africa'), ('America'), ('Asia'), ('Europe'),
    ('Antarctica')) names(name)
  LEFT JOIN (SELECT CASE lower(trim(state, ' ')) WHEN 'middle east' THEN 'asia' ELSE lower(trim(state, ' ')) END AS k,
    count(*) AS n FROM regs GROUP BY 1) s ON s.k = lower(name) GROUP BY 1""", "regs")
def state_alias_rollup(spark: SparkSession, folder: str) -> DataFrame:
    counts = label_counts(base.registrations(spark, folder), "state")
    names = ["Africa", "America", "Asia", "Europe", "Antarctica"]
    return alias_rollup(counts, "label", "n", names, {"Middle_East": "Asia"})


# --- rounds and eligibility ------------------------------------------------------------------

_ROUND_COUNTS = """, counted AS (SELECT r.*, CASE WHEN opens_at IS NOT NULL THEN
    (SELECT count(*) FROM regs WHERE regs.event_id = r.event_id AND form_timestamp <= r.opens_at) END AS registrations_at_open,
    CASE WHEN closes_at IS NOT NULL THEN
    (SELECT count(*) FROM regs WHERE regs.event_id = r.event_id AND form_timestamp <= r.closes_at) END AS registrations_at_close FROM rounds r)"""


@query(_ROUND_COUNTS + " SELECT id, registrations_at_open, registrations_at_close FROM counted", "rounds", "regs")
def eligible_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = round_counts(base.rounds(spark, folder), base.registrations(spark, folder))
    return counted.select("id", "registrations_at_open", "registrations_at_close")


@query("""SELECT strftime(m.at, '%Y-%m-%d') AS at, (SELECT count(*) FROM regs WHERE form_timestamp <= m.at) AS n
  FROM (SELECT DISTINCT o_orderdate AS at FROM orders WHERE o_orderdate IS NOT NULL) m""", "regs")
def registrations_by_moment(spark: SparkSession, folder: str) -> DataFrame:
    """Registrations up to each of many moments, read off a distributed running total."""
    moments = base.read_table(spark, folder, "orders", ["o_orderdate"])
    counted = counts_not_after(base.registrations(spark, folder), "form_timestamp", moments, "o_orderdate")
    return counted.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), "n")


@query(f"""SELECT count(*) AS total, count(CASE WHEN form_timestamp <= TIMESTAMP '2001-01-10' THEN 1 END) AS eligible,
  count(CASE WHEN form_timestamp <= TIMESTAMP '2001-01-10' AND {_LAST7} THEN 1 END) AS eligible_last_7_days
  FROM regs""", "regs")
def eligibility_last7(spark: SparkSession, folder: str) -> DataFrame:
    closes = F.lit("2001-01-10 00:00:00").cast("timestamp_ntz")
    return eligibility_summary(base.registrations(spark, folder), closes, AS_OF)


@query("""SELECT id, title, status, strftime(opens_at, '%Y-%m-%d') AS opens_at,
  strftime(closes_at, '%Y-%m-%d') AS closes_at,
  row_number() OVER (ORDER BY CASE status WHEN 'live' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END,
    rounds.opens_at ASC NULLS LAST, id) AS place FROM rounds""", "rounds")
def round_list(spark: SparkSession, folder: str) -> DataFrame:
    rounds = ranked_page(base.rounds(spark, folder), round_order(), 500, name="place")
    return rounds.select("id", "title", "status", day_text("opens_at"), day_text("closes_at"), "place")


@query("""SELECT 'asked' AS way, id, title FROM rounds WHERE id = 6 UNION ALL SELECT 'configured', id, title FROM rounds WHERE id = 2
  UNION ALL (SELECT 'first', id, title FROM rounds ORDER BY CASE status WHEN 'live' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END,
  opens_at ASC NULLS LAST, id LIMIT 1)""", "rounds")
def default_round(spark: SparkSession, folder: str) -> DataFrame:
    """A round that was asked for, the configured one when none was, and the first when that is unknown too."""
    rounds = base.rounds(spark, folder)
    ways = {"asked": pick_round(rounds, requested=6, configured=2), "configured": pick_round(rounds, configured=2),
            "first": pick_round(rounds, requested=99, configured=2)}
    out = [df.select(F.lit(way).alias("way"), "id", "title") for way, df in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- roster -----------------------------------------------------------------------------------

_SCORED = """, scored AS (SELECT r.*, (SELECT max(total_score) FROM subs s WHERE s.registration_id = r.id) AS by_id,
    (SELECT max(total_score) FROM subs s WHERE s.leader_email_normalized = r.email_normalized) AS by_email FROM regs r)"""


@query(_SCORED + " SELECT id, CAST(greatest(by_id, by_email) AS DOUBLE) AS submission_score FROM scored", "regs", "subs")
def roster_best_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = best_score(base.registrations(spark, folder), base.submissions(spark, folder))
    return scored.select("id", F.col("submission_score").cast("double").alias("submission_score"))


_REQUEST = {"af_state": "ASIA", "form_ts_from": "1996-01-01", "form_ts_to": "2000-12-31", "designation_years_min": "20",
            "designation_years_max": "2"}


@query(_SCORED + """ SELECT row, id, email, full_name, CAST(score AS DOUBLE) AS submission_score FROM (
  SELECT *, greatest(by_id, by_email) AS score,
    row_number() OVER (ORDER BY greatest(by_id, by_email) DESC NULLS LAST, id DESC) AS row FROM scored
  WHERE lower(trim(state, ' ')) = 'asia' AND form_timestamp >= TIMESTAMP '1996-01-01'
    AND form_timestamp <= TIMESTAMP '2000-12-31 23:59:59.999999' AND designation_years BETWEEN 2 AND 20)
  WHERE row BETWEEN 26 AND 50""", "regs", "subs")
def roster_page_by_score(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder)
    rows = apply_filter(base.registrations(spark, folder), RosterFilter.from_request(_REQUEST), subs)
    page = ranked_page(best_score(rows, subs), sort_columns("score", "desc"), 25, 25, name="row")
    return page.select("row", "id", "email", "full_name", F.col("submission_score").cast("double").alias("submission_score"))


@query("""SELECT id FROM regs r WHERE EXISTS (SELECT 1 FROM subs s WHERE s.challenge_id = 4 AND
    (s.registration_id = r.id OR s.leader_email_normalized = r.email_normalized))""", "regs", "subs")
def roster_participated(spark: SparkSession, folder: str) -> DataFrame:
    spec = RosterFilter(participated_round=4)
    return apply_filter(base.registrations(spark, folder), spec, base.submissions(spark, folder)).select("id")


@query("""SELECT id FROM regs r WHERE lower(trim(occupation, ' ')) IN ('college_student', 'student') AND EXISTS
  (SELECT 1 FROM subs s WHERE s.challenge_id = 2 AND s.registration_id = r.id AND s.attempts_completed = 3)""",
       "regs", "subs")
def roster_segment(spark: SparkSession, folder: str) -> DataFrame:
    spec = RosterFilter.from_request({"segment": "student", "segment_round": "2", "attempts": "3"})
    return apply_filter(base.registrations(spark, folder), spec, base.submissions(spark, folder)).select("id")


@query("""SELECT id, full_name FROM regs WHERE email ILIKE '%0_7%' OR full_name ILIKE '%0_7%'
  OR profile_name ILIKE '%0_7%' OR mobile ILIKE '%0_7%'""", "regs")
def text_search_roster(spark: SparkSession, folder: str) -> DataFrame:
    return apply_filter(base.registrations(spark, folder), RosterFilter(search="0_7")).select("id", "full_name")


@query("""SELECT CAST(id AS VARCHAR) AS id, email, full_name, coalesce(occupation, '') AS occupation,
  coalesce(strftime(form_timestamp, '%Y-%m-%d %H:%M:%S'), '') AS form_timestamp,
  coalesce(attendance_city, '') AS attendance_city,
  coalesce(strftime(session_on, '%Y-%m-%d'), '') AS session_on, session_label FROM regs""", "regs")
def export_rows_in_person(spark: SparkSession, folder: str) -> DataFrame:
    return export_rows(base.registrations(spark, folder)).select(
        "id", "email", "full_name", "occupation", "form_timestamp", "attendance_city", "session_on", "session_label"
    )


@query(""", s AS (SELECT id AS session_id, city, session_on, session_label FROM sessions),
  rs AS (SELECT r.*, s.session_id FROM regs r LEFT JOIN s ON lower(trim(attendance_city, ' ')) = s.city
    AND r.session_on = s.session_on AND trim(r.session_label, ' ') = s.session_label),
  ps AS (SELECT p.*, s.session_id FROM ip_subs p LEFT JOIN s ON lower(trim(attendance_city, ' ')) = s.city
    AND p.session_on = s.session_on AND trim(p.session_label, ' ') = s.session_label),
  sess AS (SELECT email_normalized AS e, session_id AS w FROM rs WHERE session_id IS NOT NULL
    UNION SELECT r.email_normalized, p.session_id FROM ps p JOIN regs r ON r.id = p.registration_id
    WHERE p.session_id IS NOT NULL),
  rnd AS (SELECT leader_email_normalized AS e, challenge_id AS w FROM subs WHERE challenge_id IS NOT NULL UNION
    SELECT r.email_normalized, s.challenge_id FROM subs s JOIN regs r ON r.id = s.registration_id
    WHERE s.challenge_id IS NOT NULL)
  SELECT e AS email_normalized, CAST(sum(a) AS BIGINT) AS n_sessions, CAST(sum(b) AS BIGINT) AS n_rounds
  FROM (SELECT e, 1 AS a, 0 AS b FROM sess UNION ALL SELECT e, 0, 1 FROM rnd) GROUP BY 1""", "regs", "subs", "sessions")
def participation_union(spark: SparkSession, folder: str) -> DataFrame:
    from turnout.operators.merge import relink_by_natural_key

    dim = base.sessions(spark, folder).select(
        F.col("id").alias("dim_id"), F.col("city").alias("dim_city"), F.col("session_on").alias("dim_on"),
        F.col("session_label").alias("dim_label"),
    )
    on = {"attendance_city": "dim_city", "session_on": "dim_on", "session_label": "dim_label"}
    regs = base.registrations(spark, folder)
    # Registrations and submissions find their sessions together, so the sessions are derived once.
    places = in_person_places(regs, base.in_person_submissions(spark, folder), ["attendance_city", "session_on", "session_label"])
    places = places.withColumns({"session_id": F.lit(None).cast("long"), "session_label": F.trim("session_label")})
    linked = relink_by_natural_key(places, dim, on, "session_id", "dim_id", lower=["attendance_city"])
    return participation_of(linked, base.submissions(spark, folder), regs)


@query(""", named AS (SELECT DISTINCT coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''),
    '(Unknown)') AS city, session_on, trim(session_label, ' ') AS session_label, 0 AS source FROM regs
    WHERE session_on IS NOT NULL),
  played AS (SELECT DISTINCT trim(attendance_city, ' ') AS city, session_on, trim(session_label, ' ') AS session_label,
    1 AS source FROM ip_subs WHERE sheet_kind = 'main' AND session_on IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(city), session_on, session_label ORDER BY source, city) AS rn
    FROM (SELECT * FROM named UNION ALL SELECT * FROM played))
  SELECT city, strftime(session_on, '%Y-%m-%d') AS session_on, session_label,
    city || ' · ' || strftime(session_on, '%d %b %Y')
      || CASE WHEN session_label <> '' THEN ' · ' || session_label ELSE '' END AS display
  FROM ranked WHERE rn = 1""", "regs", "ip_subs")
def session_list_merged(spark: SparkSession, folder: str) -> DataFrame:
    merged = session_list(base.registrations(spark, folder), base.in_person_submissions(spark, folder))
    return merged.select("city", day_text("session_on"), "session_label", "display")


@query(""", named AS (SELECT DISTINCT coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''),
    '(Unknown)') AS city, session_on, trim(session_label, ' ') AS session_label, 0 AS source FROM regs
    WHERE session_on IS NOT NULL),
  played AS (SELECT DISTINCT trim(attendance_city, ' ') AS city, session_on, trim(session_label, ' ') AS session_label,
    1 AS source FROM ip_subs WHERE sheet_kind = 'main' AND session_on IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(city), session_on, session_label ORDER BY source, city) AS rn
    FROM (SELECT * FROM named UNION ALL SELECT * FROM played)),
  listed AS (SELECT *, lower(city) || '|' || strftime(session_on, '%Y-%m-%d') || '|' || session_label AS scope_key FROM ranked WHERE rn = 1),
  lists AS (SELECT lower(trim(attendance_city, ' ')) || '|' || strftime(session_on, '%Y-%m-%d') || '|' || trim(session_label, ' ') AS k,
    count(*) FILTER (sheet_kind = 'main') AS ms, count(*) FILTER (sheet_kind <> 'main') AS ma FROM ip_subs GROUP BY 1),
  snaps AS (SELECT DISTINCT ON (k) lower(trim(attendance_city, ' ')) || '|' || strftime(session_on, '%Y-%m-%d') || '|' || trim(session_label, ' ') AS k,
    CAST(id % 900 AS INTEGER) AS sent, CAST(id % 300 AS INTEGER) AS acc FROM regs ORDER BY k, form_timestamp DESC NULLS LAST, id DESC)
  SELECT city, strftime(session_on, '%Y-%m-%d') AS session_on, session_label,
    CAST(CASE WHEN ms > 0 THEN ms ELSE coalesce(sent, 0) END AS BIGINT) AS rsvp_sent,
    CAST(CASE WHEN ma > 0 THEN ma ELSE coalesce(acc, 0) END AS BIGINT) AS rsvp_accepted
  FROM listed LEFT JOIN lists ON lists.k = scope_key LEFT JOIN snaps ON snaps.k = scope_key""", "regs", "ip_subs")
def session_list_rsvp(spark: SparkSession, folder: str) -> DataFrame:
    """The session list with its RSVP counts: submissions stand for imported lists, registrations for snapshots."""
    regs, subs = base.registrations(spark, folder), base.in_person_submissions(spark, folder)
    manual = subs.select(F.col("attendance_city").alias("city"), "session_on", "session_label",
                         F.when(F.col("sheet_kind") == "main", "invite_sent").otherwise("accepted").alias("list_kind"))
    snapshots = regs.select(
        "id", scope_key("attendance_city", "session_on", "session_label").alias("scope_key"), F.col("form_timestamp").alias("fetched_at"),
        (F.col("id") % 900).cast("int").alias("rsvp_invite_sent"), (F.col("id") % 300).cast("int").alias("rsvp_accepted"))
    merged = session_list_with_rsvp(regs, subs, manual, snapshots)
    return merged.select("city", day_text("session_on"), "session_label", "rsvp_sent", "rsvp_accepted")


_LABELS = {
    "attendance_cities": ("nullif(trim(attendance_city, ' '), '')", None),
    "utm_sources": ("coalesce(nullif(trim(utm_source, ' '), ''), '(none)')", 8),
    "top_city": ("coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''))", 1),
    "top_state": ("nullif(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(trim(state, ' '), ' ')], ' '), '')", 1),
    "states": ("nullif(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(trim(state, ' '), ' ')], ' '), '')", 36),
    "cities": ("coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''), '(Unknown)')", 40),
    "genders": ("coalesce(nullif(trim(gender, ' '), ''), '(unspecified)')", 8),
    "occupations": ("coalesce(nullif(trim(occupation, ' '), ''), '(unspecified)')", 8),
}


@query(", long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS facet, {e} AS label, {n or 'NULL'} AS most FROM regs" for k, (e, n) in _LABELS.items())
       + """), counted AS (SELECT facet, label, most, count(*) AS n FROM long WHERE label IS NOT NULL GROUP BY ALL)
  SELECT facet, row_number() OVER (PARTITION BY facet ORDER BY n DESC, label)::INTEGER AS rank, label, n FROM counted
  QUALIFY most IS NULL OR rank <= most""", "regs")
def dashboard_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All label counts of the registration dashboard, from one scan."""
    return dashboard_labels(base.registrations(spark, folder))


# --- reports ------------------------------------------------------------------------------------

_SUBMITTED = """count(*) AS total_submissions, count(DISTINCT leader_email_normalized) AS unique_submitters,
  count(CASE WHEN trim(deployed_link, ' ') <> '' THEN 1 END) AS deployed_count, count(total_score) AS scored_count"""


@query(_ROUND_COUNTS + f""" SELECT c.id, c.title, registrations_at_open, registrations_at_close,
  registrations_at_close - registrations_at_open AS registrations_during_window,
  coalesce(total_submissions, 0) AS total_submissions, coalesce(unique_submitters, 0) AS unique_submitters,
  coalesce(deployed_count, 0) AS deployed_count, coalesce(scored_count, 0) AS scored_count FROM counted c
  LEFT JOIN (SELECT challenge_id, {_SUBMITTED} FROM subs GROUP BY 1) s ON s.challenge_id = c.id""",
       "rounds", "regs", "subs")
def round_summary_report(spark: SparkSession, folder: str) -> DataFrame:
    report = round_summary(
        base.rounds(spark, folder), base.registrations(spark, folder), base.submissions(spark, folder)
    )
    return report.drop("event_id", "opens_at", "closes_at", "status")


@query(f"SELECT {_SUBMITTED} FROM subs", "subs")
def submission_counts_overall(spark: SparkSession, folder: str) -> DataFrame:
    return submission_counts(base.submissions(spark, folder))


@query(f"""SELECT coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''), '<unknown>') AS city,
  count(*) AS registrations, count(CASE WHEN {_LAST7} THEN 1 END) AS last_7_days FROM regs GROUP BY 1""", "regs")
def city_breakdown_report(spark: SparkSession, folder: str) -> DataFrame:
    return city_breakdown(base.registrations(spark, folder), AS_OF)


@query(f"""SELECT (SELECT count(*) FROM regs) AS registrations, (SELECT count(*) FROM regs WHERE {_LAST7}) AS last_7_days,
  (SELECT count(DISTINCT coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''))) FROM regs)
    AS distinct_cities,
  count(*) FILTER (sheet_kind = 'main') AS main_submissions,
  count(DISTINCT leader_email_normalized) FILTER (sheet_kind = 'main') AS main_leaders,
  count(*) FILTER (sheet_kind = 'main' AND trim(deployed_link, ' ') <> '') AS main_deployed,
  count(total_score) FILTER (sheet_kind = 'main') AS main_scored,
  count(DISTINCT lower(trim(attendance_city, ' '))) FILTER (sheet_kind = 'main') AS cities_with_submissions,
  count(*) FILTER (sheet_kind = 'warmup') AS warmup_submissions FROM ip_subs""", "regs", "ip_subs")
def in_person_summary_row(spark: SparkSession, folder: str) -> DataFrame:
    return in_person_summary(base.registrations(spark, folder), base.in_person_submissions(spark, folder), AS_OF)


@query("""SELECT (SELECT count(*) FROM regs) AS registrations, count(*) AS submissions,
  count(DISTINCT leader_email_normalized) AS leaders, (SELECT CAST(sum(delta) AS DOUBLE) FROM ledger) AS credits,
  round(count(DISTINCT leader_email_normalized) * 100.0 / (SELECT count(*) FROM regs), 2) AS conversion_pct FROM subs""",
       "regs", "subs", "ledger")
def overview_counts_row(spark: SparkSession, folder: str) -> DataFrame:
    return overview_counts(
        base.registrations(spark, folder), base.submissions(spark, folder), base.ledger(spark, folder)
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice >= 1000 THEN
    regexp_replace(printf('%.1f', o_totalprice / 1000), '\\.0$', '') || 'k'
    WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
    ELSE printf('%.2f', o_totalprice) END AS compact,
  coalesce(regexp_replace(regexp_replace(printf('%.4f', o_totalprice), '0+$', ''), '\\.$', ''), '—') AS exact
  FROM orders""")
def score_formats(spark: SparkSession, folder: str) -> DataFrame:
    orders = base.read_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"])
    return orders.select(
        F.col("o_orderkey").alias("id"), compact_number("o_totalprice").alias("compact"),
        score_text("o_totalprice").alias("exact"),
    )


@query("SELECT o_orderkey AS id, " + _INITCAP.format(c="o_orderpriority") + " AS label FROM orders")
def initcap_labels(spark: SparkSession, folder: str) -> DataFrame:
    orders = base.read_table(spark, folder, "orders", ["o_orderkey", "o_orderpriority"])
    return orders.select(F.col("o_orderkey").alias("id"), initcap_words("o_orderpriority").alias("label"))
