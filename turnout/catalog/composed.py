"""Queries over compositions: dashboards, overviews, statistics with crossover, exports, mappings and details."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import AS_OF, query
from turnout.catalog.ingest import scratch
from turnout.functions.dates import display_timestamp, effective_range, nullify_sentinel
from turnout.functions.text import city_slug, session_display
from turnout.operators.counts import daily_counts
from turnout.operators.merge import upsert
from turnout.operators.resolve import natural_key_fallback, validate_rows
from turnout.operators.roster import in_list, registrant_submissions
from turnout.operators.sessions import event_snapshots
from turnout.plans.bootcamp import bootcamp_options
from turnout.plans.crossover import CrossoverParams, crossover
from turnout.plans.dashboard import overview, registration_dashboard
from turnout.plans.leaderboards import round_tops
from turnout.plans.reports import export_csv, export_report
from turnout.plans.stats import round_stats, session_stats
from turnout.sources.headers import apply_mapping, require_columns
from turnout.sources.payloads import payload_digest
from turnout.streaming.jobs import append_snapshot


# --- dashboards ------------------------------------------------------------------------------


@query("""SELECT count(DISTINCT email_normalized) AS n FROM regs WHERE email_normalized IN
  (SELECT leader_email_normalized FROM ip_subs WHERE track = 'F')""", "regs", "ip_subs")
def led_in_person(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.in_person_submissions(spark, folder).where("track = 'F'")
    return registration_dashboard(base.registrations(spark, folder), AS_OF, ip_subs=subs)["led_in_person"]


@query("""SELECT 'genders' AS metric, CASE WHEN trim(gender, ' ') <> '' THEN trim(gender, ' ') ELSE '(unspecified)' END AS label, count(*) AS n FROM regs GROUP BY 2
  UNION ALL (SELECT 'cities', coalesce(nullif(trim(attendance_city, ' '), ''), nullif(trim(city, ' '), ''), '(Unknown)'), count(*) AS n FROM regs
    GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 40)
  UNION ALL SELECT 'total', 'all', count(*) FROM regs""", "regs")
def dashboard_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Three of the dashboard's results as they come out of its composition."""
    parts = registration_dashboard(base.registrations(spark, folder), AS_OF)
    rows = [parts[m].select(F.lit(m).alias("metric"), "label", "n") for m in ("genders", "cities")]
    total = parts["totals"].select(F.lit("total").alias("metric"), F.lit("all").alias("label"), F.col("total").alias("n"))
    return rows[0].unionByName(rows[1]).unionByName(total)


@query("""SELECT strftime(CAST(form_timestamp + INTERVAL 330 MINUTE AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM regs
  WHERE CAST(form_timestamp + INTERVAL 330 MINUTE AS DATE) = DATE '1996-05-06' GROUP BY 1
  UNION ALL SELECT '1996-05-06', 0 WHERE NOT EXISTS (SELECT 1 FROM regs WHERE CAST(form_timestamp + INTERVAL 330 MINUTE AS DATE) = DATE '1996-05-06')""", "regs")
def range_with_a_start_only(spark: SparkSession, folder: str) -> DataFrame:
    """A range of which only the start is given is that one day."""
    first, last = effective_range(date(1996, 5, 6), None, date(1990, 1, 1), date(2030, 1, 1))
    days = daily_counts(base.registrations(spark, folder), "form_timestamp", first, last)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("""SELECT 'virtual' AS track, count(*) AS row_n, count(total_score) AS scored_n FROM subs UNION ALL
  SELECT 'round', count(*), count(total_score) FROM subs WHERE challenge_id = 3 UNION ALL
  SELECT 'in_person', count(*), count(total_score) FROM ip_subs WHERE sheet_kind = 'main'""", "ip_subs")
def overview_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = overview(base.registrations(spark, folder), base.submissions(spark, folder), base.in_person_submissions(spark, folder),
                     base.ledger(spark, folder), AS_OF, 3)
    rows = [parts[p].select(F.lit(n).alias("track"), "row_n", "scored_n") for p, n in
            (("virtual_scores", "virtual"), ("round_scores", "round"), ("in_person_scores", "in_person"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- statistics with crossover -----------------------------------------------------------------

_PAIR = CrossoverParams(1, 2, sheet_kind="main")
_BOTH = """ SELECT (SELECT count(DISTINCT e) FROM i) AS distinct_ip_leaders, (SELECT count(DISTINCT e) FROM v) AS distinct_v_leaders,
  (SELECT count(DISTINCT e) FROM i WHERE e IN (SELECT e FROM v)) AS both_tracks,
  (SELECT count(DISTINCT e) FROM i WHERE e NOT IN (SELECT e FROM v)) AS ip_only,
  (SELECT count(DISTINCT e) FROM v WHERE e NOT IN (SELECT e FROM i)) AS v_only"""
_HERE = """lower(trim(attendance_city, ' ')) = 'nation_4' AND session_on = DATE '1997-04-01' AND lower(trim(session_label, ' ')) = ''"""


@query(""", i AS (SELECT leader_email_normalized AS e FROM ip_subs WHERE sheet_kind = 'main' AND track = 'F'),
  v AS (SELECT leader_email_normalized AS e FROM subs WHERE challenge_id = 5)""" + _BOTH, "ip_subs")
def round_crossover(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder)
    found = round_stats(subs, base.registrations(spark, folder), base.rounds(spark, folder), 5,
                        base.in_person_submissions(spark, folder).where("track = 'F'"), _PAIR)
    return found["crossover"]


def _session(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return session_stats(
        base.in_person_submissions(spark, folder), base.registrations(spark, folder), base.sessions(spark, folder),
        "nation_4", date(1997, 4, 1), "", base.submissions(spark, folder).where("track = 'P'"), _PAIR)


@query(f""", i AS (SELECT leader_email_normalized AS e FROM ip_subs WHERE sheet_kind = 'main' AND {_HERE}),
  v AS (SELECT leader_email_normalized AS e FROM subs WHERE track = 'P')""" + _BOTH, "ip_subs")
def session_crossover(spark: SparkSession, folder: str) -> DataFrame:
    return _session(spark, folder)["crossover"]


_SEG = f""", seg AS (SELECT s.*, CASE WHEN s.registration_id IS NULL THEN 'unknown'
    WHEN lower(trim(r.occupation, ' ')) IN ('college_student', 'student') THEN 'student'
    WHEN lower(trim(r.occupation, ' ')) IN ('professional', 'startup', 'freelance', 'freelancer') THEN 'professional' ELSE 'other' END AS segment
  FROM ip_subs s LEFT JOIN regs r ON r.id = s.registration_id WHERE s.sheet_kind = 'main' AND lower(trim(s.attendance_city, ' ')) = 'nation_4'
    AND s.session_on = DATE '1997-04-01' AND lower(trim(s.session_label, ' ')) = '')"""


@query(_SEG + """ SELECT count(*) FILTER (segment = 'unknown') AS team_segment_unknown, count(*) FILTER (segment = 'student') AS team_segment_student,
  count(*) FILTER (segment = 'professional') AS team_segment_professional, count(*) FILTER (segment = 'other') AS team_segment_other FROM seg""", "ip_subs", "regs")
def session_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _session(spark, folder)["segments"]


@query(_SEG + """ SELECT segment, CASE WHEN attempts_completed IS NULL OR attempts_completed < 1 THEN 0 ELSE attempts_completed END AS bucket, count(*) AS n
  FROM seg WHERE segment IN ('student', 'professional') GROUP BY 1, 2""", "ip_subs", "regs")
def session_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return _session(spark, folder)["attempts"]


@query(""", i AS (SELECT leader_email_normalized AS e FROM ip_subs WHERE event_id = 1 AND lower(session_label) LIKE '%orn%'),
  v AS (SELECT leader_email_normalized AS e FROM subs WHERE event_id = 2)""" + _BOTH, "ip_subs")
def crossover_by_label_part(spark: SparkSession, folder: str) -> DataFrame:
    params = CrossoverParams(1, 2, label_contains="ORN")
    return crossover(base.in_person_submissions(spark, folder), base.submissions(spark, folder), params)[0]


# --- merges -----------------------------------------------------------------------------------

_MERGED = """, cur AS (SELECT leader_email_normalized AS e, challenge_id AS c, team_name, total_score, imported_at FROM subs
    QUALIFY row_number() OVER (PARTITION BY e, c ORDER BY id) = 1),
  inc AS (SELECT leader_email_normalized AS e, CAST(challenge_id % 4 AS INTEGER) AS c, team_name || ' new' AS team_name,
      CASE WHEN id % 3 > 0 THEN total_score END AS total_score FROM subs
    QUALIFY row_number() OVER (PARTITION BY e, challenge_id % 4 ORDER BY id DESC) = 1)
  SELECT coalesce(cur.e, inc.e) AS e, coalesce(cur.c, inc.c) AS c, coalesce(inc.team_name, cur.team_name) AS team_name,
    CAST(coalesce(inc.total_score, cur.total_score) AS DOUBLE) AS total_score,
    CASE WHEN inc.e IS NULL THEN strftime(cur.imported_at, '%Y-%m-%d') ELSE '2001-01-15' END AS imported_at
  FROM cur FULL JOIN inc ON cur.e = inc.e AND cur.c = inc.c"""


@query(_MERGED, "subs")
def upsert_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions by leader and round; the batch repeats keys, of which the last row counts, and sets the import time."""
    subs = base.submissions(spark, folder).select(
        F.col("leader_email_normalized").alias("e"), F.col("challenge_id").alias("c"), "team_name", "total_score", "imported_at", "id")
    current = subs.groupBy("e", "c").agg(*[F.min_by(x, "id").alias(x) for x in ("team_name", "total_score", "imported_at")])
    batch = subs.select("e", (F.col("c") % 4).cast("int").alias("c"), F.concat("team_name", F.lit(" new")).alias("team_name"),
                        F.when(F.col("id") % 3 > 0, F.col("total_score")).alias("total_score"), "id")
    now = F.lit(AS_OF.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    merged = upsert(current, batch, ["e", "c"], ["total_score"], touch={"imported_at": now}, order=["id"])
    return merged.select("e", "c", "team_name", F.col("total_score").cast("double").alias("total_score"),
                         F.date_format("imported_at", "yyyy-MM-dd").alias("imported_at"))


@query(""", k AS (SELECT event_id, challenge_id, sheet_kind, session_on, nullif(trim(session_label, ' '), '') AS label, leader_id % 50 AS who, max(id) AS last
    FROM subs GROUP BY ALL) SELECT count(*) AS n_rows, sum(last)::BIGINT AS last_ids, count(*) FILTER (label IS NULL) AS without_label FROM k""", "subs")
def upsert_six_part_key(spark: SparkSession, folder: str) -> DataFrame:
    """A key of six parts, one of which may be NULL, merged twice over with repeats."""
    subs = base.submissions(spark, folder).select(
        "event_id", "challenge_id", "sheet_kind", "session_on", F.nullif(F.trim("session_label"), F.lit("")).alias("label"),
        (F.col("leader_id") % 50).alias("who"), F.col("id").alias("last"))
    keys = ["event_id", "challenge_id", "sheet_kind", "session_on", "label", "who"]
    first = upsert(subs.limit(0), subs.where("last % 2 = 0"), keys, order=["last"]).drop("_action")
    both = upsert(first, subs, keys, order=["last"])
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("last").alias("last_ids"), F.count_if(F.col("label").isNull()).alias("without_label"))


# --- sources and functions ----------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS occupation FROM customer")
def mapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that a user mapped by hand; the required ones are checked first."""
    customer = base.read_table(spark, folder, "customer")
    require_columns(customer.columns, ["c_custkey", "c_name"])
    return apply_mapping(customer, {"id": "c_custkey", "full_name": " c_name ", "occupation": "c_mktsegment", "city": None}, ["id", "full_name"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN strftime(DATE '1970-01-01' + CAST(c_custkey % 3 AS INTEGER) - 1, '%Y-%m-%d') END AS day,
    c_custkey % 3 = 1 AS was_sentinel FROM customer""")
def sentinel_dates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1970-01-01").cast("date"), (key % 3 - 1).cast("int"))
    given = F.when(key % 3 > 0, day)
    rows = base.read_table(spark, folder, "customer", ["c_custkey"]).select(key.alias("id"), given.alias("given"))
    return rows.select("id", F.date_format(F.coalesce(nullify_sentinel("given"), F.when(F.col("given") == F.lit(date(1970, 1, 1)), F.col("given"))), "yyyy-MM-dd").alias("day"),
                       (F.col("given").isNotNull() & nullify_sentinel("given").isNull()).alias("was_sentinel"))


@query("""SELECT event_id AS id, strftime(ts, '%d-%m-%Y %H:%M:%S') AS shown, substr(sha256(props), 1, 32) AS digest FROM events WHERE props IS NOT NULL""")
def shown_times_and_digests(spark: SparkSession, folder: str) -> DataFrame:
    events = base.read_table(spark, folder, "events", ["event_id", "ts", "props"]).where("props IS NOT NULL")
    return events.select(F.col("event_id").alias("id"), display_timestamp("ts").alias("shown"), payload_digest("props").alias("digest"))


@query("""SELECT n_nationkey AS id, replace(lower('  ' || n_name || ' Old  Town ').trim(), '  ', ' ').replace(' ', '_') AS slug FROM nation""")
def city_slugs(spark: SparkSession, folder: str) -> DataFrame:
    nation = base.read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    return nation.select(F.col("n_nationkey").alias("id"), city_slug(F.concat(F.lit("  "), "n_name", F.lit(" Old  Town "))).alias("slug"))


@query("""SELECT 'row ' || c_custkey || ': no balance' AS error FROM customer WHERE c_acctbal < 0 UNION ALL
  SELECT 'row ' || c_custkey || ': no segment' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def numbered_row_errors(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"no balance": F.col("c_acctbal") < 0, "no segment": F.col("c_mktsegment") == "BUILDING"}
    rejected = validate_rows(base.read_table(spark, folder, "customer"), rules, "c_custkey")[1]
    return rejected.select(F.explode("errors").alias("error"))


# --- lists, links and details ---------------------------------------------------------------------


@query("""SELECT id, email_normalized FROM regs WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""", "regs")
def registrations_in_list(spark: SparkSession, folder: str) -> DataFrame:
    wanted = base.read_table(spark, folder, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '2-HIGH'")
    return in_list(base.registrations(spark, folder), "id", wanted, "o_custkey").select("id", "email_normalized")


_LINKED = """, dim AS (SELECT *, row_number() OVER (PARTITION BY city, session_on ORDER BY id) AS rn FROM sessions),
  facts AS (SELECT s.id, lower(trim(s.attendance_city, ' ')) AS city, s.session_on,
    CASE WHEN s.track <> 'P' THEN d.id END AS sid FROM ip_subs s JOIN sessions d ON d.city = lower(trim(s.attendance_city, ' '))
      AND d.session_on = s.session_on AND d.session_label = trim(s.session_label, ' '))"""


@query(_LINKED + """ SELECT f.id, coalesce(a.session_label, b.session_label) AS session_label FROM facts f
  LEFT JOIN dim a ON a.id = f.sid LEFT JOIN dim b ON f.sid IS NULL AND b.city = f.city AND b.session_on = f.session_on AND b.rn = 1""", "sessions")
def session_by_id_or_key(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by id; facts without one by city and day, of which the smallest id counts."""
    dim = base.sessions(spark, folder)
    own = dim.select(F.col("city").alias("dc"), F.col("session_on").alias("do"), F.col("session_label").alias("dl"), F.col("id").alias("did"))
    subs = base.in_person_submissions(spark, folder).withColumn("city", F.lower(F.trim("attendance_city")))
    facts = subs.join(own, (F.col("city") == F.col("dc")) & (F.col("session_on") == F.col("do")) & (F.trim("session_label") == F.col("dl"))).select(
        "id", "city", "session_on", F.when(F.col("track") != "P", F.col("did")).alias("sid"))
    side = dim.select(F.col("id").alias("dim_id"), F.col("city").alias("town"), F.col("session_on").alias("held_on"), "session_label")
    return natural_key_fallback(facts, side, "sid", "dim_id", {"city": "town", "session_on": "held_on"}, ["session_label"]).select("id", "session_label")


@query(""", d AS (SELECT id, city || ' · ' || strftime(session_on, '%d %b %Y') || CASE WHEN session_label <> '' THEN ' · ' || session_label ELSE '' END AS display,
    city, session_on, session_label FROM sessions)
  SELECT s.registration_id AS id, count(*) AS n, string_agg(s.team_name || '|' || d.display, ';' ORDER BY s.sheet_kind, s.team_name, s.session_on, s.id) AS teams
  FROM ip_subs s JOIN d ON d.city = lower(trim(s.attendance_city, ' ')) AND d.session_on = s.session_on AND d.session_label = trim(s.session_label, ' ')
  JOIN regs r ON r.id = s.registration_id AND r.event_id = s.event_id GROUP BY 1""", "sessions", "regs")
def registrant_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions of every registrant of the in-person event, with the names of their sessions."""
    dim = base.sessions(spark, folder).withColumn("display", session_display("city", "session_on", "session_label"))
    own = dim.select(F.col("city").alias("dc"), F.col("session_on").alias("do"), F.col("session_label").alias("dl"), F.col("id").alias("session_id"))
    subs = base.in_person_submissions(spark, folder)
    linked = subs.join(own, (F.lower(F.trim("attendance_city")) == F.col("dc")) & (F.col("session_on") == F.col("do")) & (F.trim("session_label") == F.col("dl")))
    detail = registrant_submissions(base.registrations(spark, folder), linked, dim, ["total_score"])
    names = F.transform("submissions", lambda s: F.concat_ws("|", s["team_name"], s["display"]))
    return detail.select("id", F.size("submissions").cast("long").alias("n"), F.array_join(names, ";").alias("teams"))


@query("""SELECT o_custkey % 5 AS event_id, 'scope' || (o_custkey % 40) AS scope_key, max(o_orderkey) AS id FROM orders GROUP BY 1, 2""")
def snapshots_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots appended in two runs; the latest of every scope of every event."""
    orders = base.read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    rows = orders.select((F.col("o_custkey") % 5).alias("event_id"), F.concat(F.lit("scope"), (F.col("o_custkey") % 40).cast("string")).alias("scope_key"),
                         F.lit(0).alias("fetched_at"), F.col("o_orderkey").alias("id"), "o_totalprice")
    path = scratch(spark)
    for half in (0, 1):
        append_snapshot(rows.where(F.col("id") % 2 == half), path)
    return event_snapshots(spark.read.schema(rows.schema).parquet(path)).select("event_id", "scope_key", "id")


@query("""SELECT s_suppkey AS capacity, 'morning' AS slot FROM supplier WHERE s_suppkey % 4 = 0""")
def bootcamp_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Of sessions without a city, with an unknown slot and with both, only the last can be chosen."""
    key = F.col("s_suppkey")
    rows = base.read_table(spark, folder, "supplier").select(
        F.when(key % 4 == 1, " ").otherwise("pune").alias("city"), F.date_add(F.lit("2020-01-01").cast("date"), (key % 99).cast("int")).alias("bootcamp_on"),
        F.when(key % 4 == 0, "Morning ").when(key % 4 == 1, "pm").otherwise("noon").alias("slot"), key.alias("activations"))
    return bootcamp_options(rows).select(F.col("activations").alias("capacity"), "slot")


# --- exports ------------------------------------------------------------------------------------


@query("""SELECT challenge_id, rank, team_name FROM (SELECT challenge_id, (row_number() OVER (PARTITION BY challenge_id
    ORDER BY total_score DESC NULLS LAST, export_created_at, id))::INT AS rank, team_name FROM subs) WHERE rank <= 25""", "subs")
def exported_report(spark: SparkSession, folder: str) -> DataFrame:
    """The teams section of a report, written and read back."""
    path = scratch(spark)
    export_report({"Teams": round_tops(base.submissions(spark, folder), 25)}, path)
    return spark.read.parquet(f"{path}/Teams").select("challenge_id", "rank", "team_name")


@query("""SELECT CAST(id AS VARCHAR) AS id, coalesce(occupation, '') AS occupation, coalesce(strftime(session_on, '%Y-%m-%d'), '') AS session_on FROM regs""", "regs")
def exported_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A roster export, written and read back as text."""
    path = scratch(spark)
    export_csv(base.registrations(spark, folder), path)
    rows = spark.read.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("occupation", "session_on")])
