"""Overlap, cohorts, retention, crossover and RSVP state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import query
from turnout.functions.text import scope_key
from turnout.operators.dedupe import latest_per_key
from turnout.operators.overlap import cohort_vs_prior, overlap, retention_top_n, with_prior
from turnout.operators.resolve import pair_stats
from turnout.operators.sessions import eligible_members, latest_snapshots, rsvp_buckets, rsvp_overlay
from turnout.plans.crossover import CrossoverParams, crossover
from turnout.plans.reports import track_overlap_report
from turnout.plans.stats import chronological, session_cohorts


@query(""", a AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE track = 'F'),
  b AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE track = 'P')
  SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
    (SELECT count(*) FROM a JOIN b USING (e)) AS both,
    (SELECT count(*) FROM a WHERE e NOT IN (SELECT e FROM b)) AS a_only,
    (SELECT count(*) FROM b WHERE e NOT IN (SELECT e FROM a)) AS b_only""", "subs")
def track_overlap(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder)
    return overlap(subs.where("track = 'F'"), subs.where("track = 'P'"), "leader_email_normalized")


@query(""", ip AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE track = 'F'),
  sb AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE track = 'O'), rg AS (
    SELECT DISTINCT email_normalized AS e FROM regs WHERE form_timestamp IS NOT NULL)
  SELECT (SELECT count(*) FROM ip) AS in_person_distinct_emails,
    (SELECT count(*) FROM ip JOIN rg USING (e)) AS also_registered_virtual,
    (SELECT count(*) FROM ip JOIN sb USING (e)) AS also_submitted_virtual""", "subs", "regs")
def track_overlap_report_row(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder)
    leaders = subs.where("track = 'F'").select(F.col("leader_email_normalized").alias("email_normalized"))
    regs = base.registrations(spark, folder).where("form_timestamp IS NOT NULL")
    return track_overlap_report(leaders, regs, subs.where("track = 'O'"))


_PARAMS = CrossoverParams.from_request({"sheet_kind": " MAIN ", "virtual_state": "asia", "city_limit": "10"}, 1, 2)
_CROSSOVER = """, ip AS (SELECT * FROM ip_subs WHERE event_id = 1 AND sheet_kind = 'main' AND track = 'F'),
  v AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE event_id = 2 AND track = 'P' AND
    leader_email_normalized IN (SELECT email_normalized FROM regs WHERE lower(trim(state, ' ')) = 'asia'))"""


def _crossover(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    regs = base.registrations(spark, folder).withColumn("event_id", F.lit(2))
    return crossover(
        base.in_person_submissions(spark, folder).where("track = 'F'"),
        base.submissions(spark, folder).where("track = 'P'"), _PARAMS, virtual_regs=regs,
    )


@query(_CROSSOVER + """ SELECT (SELECT count(DISTINCT leader_email_normalized) FROM ip) AS distinct_ip_leaders,
  (SELECT count(*) FROM v) AS distinct_v_leaders,
  (SELECT count(*) FROM v WHERE e IN (SELECT leader_email_normalized FROM ip)) AS both_tracks,
  (SELECT count(DISTINCT leader_email_normalized) FROM ip WHERE leader_email_normalized NOT IN (SELECT e FROM v)) AS ip_only,
  (SELECT count(*) FROM v WHERE e NOT IN (SELECT leader_email_normalized FROM ip)) AS v_only""", "ip_subs", "regs")
def crossover_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _crossover(spark, folder)[0]


@query(_CROSSOVER + """ SELECT attendance_city, count(*) AS n_leaders FROM (
    SELECT leader_email_normalized, min(trim(attendance_city, ' ')) AS attendance_city FROM ip
    WHERE leader_email_normalized IN (SELECT e FROM v) GROUP BY 1)
  GROUP BY 1 ORDER BY n_leaders DESC, attendance_city LIMIT 10""", "ip_subs", "regs")
def crossover_city_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _crossover(spark, folder)[1]


_COHORT = """, ds AS (SELECT DISTINCT {round} AS r, leader_email_normalized AS e FROM {subs}),
  lab AS (SELECT o.{key} AS r, ds.e, EXISTS (SELECT 1 FROM ds p WHERE p.r = o.prior AND p.e = ds.e) AS in_prev
    FROM ord o JOIN ds ON ds.r = o.{key})
  SELECT {out}, o.prior AS prior_{name}, count(l.e) AS distinct_teams,
    count(*) FILTER (l.in_prev) AS returning_from_prior, count(*) FILTER (NOT l.in_prev) AS fresh_vs_prior
  FROM ord o LEFT JOIN lab l ON l.r = o.{key} GROUP BY ALL"""


@query(""", ord AS (SELECT *, lag(id) OVER w AS prior, lag(title) OVER w AS prior_title FROM rounds
    WINDOW w AS (ORDER BY closes_at ASC NULLS LAST, opens_at ASC NULLS LAST, id))""" + _COHORT.format(
    round="challenge_id", subs="subs", key="id", name="challenge_id", out="o.id AS challenge_id, o.prior_title"
), "rounds", "subs")
def cohort_vs_prior_round(spark: SparkSession, folder: str) -> DataFrame:
    ordered = with_prior(base.rounds(spark, folder), "id", chronological(), ["title"]).withColumnsRenamed(
        {"id": "challenge_id", "prior_id": "prior_challenge_id"}
    )
    out = cohort_vs_prior(base.submissions(spark, folder), ordered, "challenge_id", "leader_email_normalized")
    return out.select(
        "challenge_id", "prior_challenge_id", "prior_title", "distinct_teams", "returning_from_prior", "fresh_vs_prior"
    )


@query(""", ord AS (SELECT *, lag(id) OVER (PARTITION BY event_id ORDER BY session_on ASC NULLS FIRST,
      lower(trim(session_label, ' ')), id) AS prior FROM sessions),
  member AS (SELECT s.id AS sid, i.leader_email_normalized FROM ip_subs i JOIN sessions s
    ON lower(trim(i.attendance_city, ' ')) = lower(trim(s.city, ' ')) AND i.session_on = s.session_on
    AND lower(trim(i.session_label, ' ')) = lower(trim(s.session_label, ' ')) WHERE i.sheet_kind = 'main')"""
       + _COHORT.format(round="sid", subs="member", key="id", name="session_id", out="o.id AS session_id"), "sessions")
def cohort_vs_prior_session(spark: SparkSession, folder: str) -> DataFrame:
    out = session_cohorts(base.in_person_submissions(spark, folder), base.sessions(spark, folder))
    return out.select("session_id", "prior_session_id", "distinct_teams", "returning_from_prior", "fresh_vs_prior")


@query(""", c1 AS (SELECT leader_email_normalized AS e, max(total_score) AS best, min(export_created_at) AS first_at
    FROM subs WHERE challenge_id = 2 GROUP BY 1),
  c2 AS (SELECT DISTINCT leader_email_normalized AS e FROM subs WHERE challenge_id = 3),
  top AS (SELECT e FROM c1 ORDER BY best DESC NULLS LAST, first_at ASC NULLS LAST, e LIMIT 250)
  SELECT (SELECT count(*) FROM c1) AS first_distinct, (SELECT count(*) FROM c2) AS second_distinct,
    (SELECT count(*) FROM c1 JOIN c2 USING (e)) AS first_also_in_second,
    (SELECT count(*) FROM top JOIN c2 USING (e)) AS top_n_also_in_second""", "subs")
def retention_of_top_250(spark: SparkSession, folder: str) -> DataFrame:
    return retention_top_n(
        base.submissions(spark, folder), 2, 3, "challenge_id", "leader_email_normalized", "total_score",
        "export_created_at", 250,
    )


@query("""SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS converted,
  count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, bool_or(event_type = 'view') AS a, bool_or(event_type = 'purchase') AS b
    FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2)""")
def funnel_pairs(spark: SparkSession, folder: str) -> DataFrame:
    events = base.read_table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return pair_stats(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), ["user_id", "day"])


@query("""SELECT s.id, s.challenge_id, EXISTS (SELECT 1 FROM rounds r JOIN programmes p ON p.id = r.event_id AND p.kind = 'virtual'
      JOIN regs m ON m.event_id = r.event_id AND m.form_timestamp <= r.closes_at
      WHERE r.id = s.challenge_id AND m.email_normalized = s.leader_email_normalized) AS eligible FROM subs s""",
       "subs", "regs", "rounds", "programmes")
def eligible_submissions(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder).select("id", "challenge_id", "leader_email_normalized")
    out = eligible_members(
        subs, base.registrations(spark, folder), base.rounds(spark, folder), base.programmes(spark, folder),
        ("leader_email_normalized", "challenge_id"),
    )
    return out.select("id", "challenge_id", "eligible")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1""")
def latest_event_per_user(spark: SparkSession, folder: str) -> DataFrame:
    events = base.read_table(spark, folder, "events").drop("props")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"]).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )


@query("""SELECT conv_id, turn, role, text FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_turn(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(base.read_table(spark, folder, "conversations"), ["conv_id"], ["turn"])


def _rsvp_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions are customers, imported lists are their purchases and views, snapshots are order rows."""
    dim = base.enrolled(spark, folder).select(
        F.col("participant_id").alias("session_id"), F.col("participant_id").cast("string").alias("scope_key")
    )
    manual = base.read_table(spark, folder, "events").where("event_type IN ('purchase', 'view')").select(
        F.col("user_id").alias("session_id"),
        F.when(F.col("event_type") == "purchase", "accepted").otherwise("invite_sent").alias("list_kind"),
    )
    snapshots = base.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("scope_key"),
        F.col("o_orderdate").alias("fetched_at"), F.floor("o_totalprice").cast("int").alias("rsvp_invite_sent"),
        F.floor(F.col("o_totalprice") / 10).cast("int").alias("rsvp_accepted"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("checked_in_participants"),
    )
    return dim, manual, snapshots


_LATEST = """latest AS (SELECT CAST(o_custkey AS VARCHAR) AS scope_key, o_orderdate AS fetched_at,
    CAST(floor(o_totalprice) AS INTEGER) AS sent, CAST(floor(o_totalprice / 10) AS INTEGER) AS acc,
    CAST(floor(o_totalprice / 100) AS INTEGER) AS chk FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query("WITH " + _LATEST + """, manual AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS ms,
    count(*) FILTER (event_type = 'purchase') AS ma FROM events GROUP BY 1)
  SELECT c_custkey AS session_id, CAST(c_custkey AS VARCHAR) AS scope_key,
    CAST(CASE WHEN ms > 0 THEN ms ELSE coalesce(sent, 0) END AS BIGINT) AS rsvp_sent,
    CAST(CASE WHEN ma > 0 THEN ma ELSE coalesce(acc, 0) END AS BIGINT) AS rsvp_accepted
  FROM customer LEFT JOIN manual ON user_id = c_custkey LEFT JOIN latest ON scope_key = CAST(c_custkey AS VARCHAR)""")
def rsvp_overlay_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rsvp_overlay(*_rsvp_inputs(spark, folder))


@query("WITH " + _LATEST + """ SELECT CAST(c_custkey AS VARCHAR) AS scope_key, s_name AS external_key,
    sent AS rsvp_invite_sent, acc AS rsvp_accepted, chk AS checked_in_participants,
    strftime(fetched_at, '%Y-%m-%d') AS fetched_at
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN latest ON scope_key = CAST(c_custkey AS VARCHAR)""")
def latest_snapshot_per_scope(spark: SparkSession, folder: str) -> DataFrame:
    dim, _, snapshots = _rsvp_inputs(spark, folder)
    mappings = base.read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("scope_key"), F.col("s_name").alias("external_key")
    )
    return latest_snapshots(dim.select("scope_key"), mappings, snapshots).withColumn(
        "fetched_at", F.date_format("fetched_at", "yyyy-MM-dd")
    )


@query("""SELECT 'user-' || user_id AS email, CASE min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1
    WHEN 'click' THEN 2 WHEN 'view' THEN 3 END) WHEN 0 THEN 'checked_in' WHEN 1 THEN 'accepted_not_attended'
    WHEN 2 THEN 'pending' WHEN 3 THEN 'invite_sent' END AS bucket
  FROM events WHERE event_type IN ('purchase', 'signup', 'click', 'view') GROUP BY 1""")
def rsvp_bucket(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    members = base.read_table(spark, folder, "events").select(
        F.concat(F.lit(" User-"), F.col("user_id").cast("string")).alias("address"),
        F.when(kind == "purchase", "checkedInParticipants").when(kind == "signup", "rsvpAccepted")
        .when(kind == "click", "rsvpPending").when(kind == "view", "rsvpInviteSent").alias("list_key"),
    )
    return rsvp_buckets(members, "address")


@query("""SELECT id, lower(trim(attendance_city, ' ')) || '|' || coalesce(strftime(session_on, '%Y-%m-%d'), '') || '|'
  || trim(session_label, ' ') AS scope_key FROM regs""", "regs")
def scope_keys(spark: SparkSession, folder: str) -> DataFrame:
    return base.registrations(spark, folder).select(
        "id", scope_key("attendance_city", "session_on", "session_label").alias("scope_key")
    )


