"""Roles of the driver's tables, as DataFrames and as the same SQL.

customer, nation and region are the registrations; orders are the submissions, one round per
calendar year; events are the ledger and the activity log.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.functions.text import normalise_email
from turnout.session import SQL_SETTINGS
from turnout.sources.files import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Moment at which the registered queries look at the data.
AS_OF = datetime(2001, 1, 15, 12, 0, 0)


def query(sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Register a query under its function name; ``parts`` name the shared SQL parts it uses."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in SQL_SETTINGS.items():
                if spark.conf.get(key, None) != value:
                    spark.conf.set(key, value)
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = with_parts(parts) + sql
        return fn

    return register


def day_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def time_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- registrations -------------------------------------------------------------------------


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    base = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    seconds = (F.col("c_custkey") * 86413) % 207360000
    moment = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    form = F.when(F.col("c_acctbal") >= -900, moment)
    segment = F.col("c_mktsegment")
    born = F.date_add(F.lit("1960-02-29").cast("date"), (F.col("c_custkey") % 14000).cast("int"))
    return base.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("event_id"),
        F.concat("c_name", F.lit("@Example.org")).alias("email"),
        normalise_email(F.concat("c_name", F.lit("@Example.org"))).alias("email_normalized"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("profile_name"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "9").alias("mobile"),
        F.when(segment == "BUILDING", " College_Student").when(segment == "AUTOMOBILE", "student")
        .when(segment == "MACHINERY", "Professional ").when(segment == "HOUSEHOLD", segment).alias("occupation"),
        F.concat(segment, F.lit(" ( "), (F.col("c_custkey") % 30).cast("string"), F.lit(" )")).alias("designation_raw"),
        (F.col("c_custkey") % 30).cast("int").alias("designation_years"),
        segment.alias("designation"),
        F.col("n_name").alias("city"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lower("r_name")).otherwise(F.col("r_name")).alias("state"),
        F.col("r_name").alias("country"),
        F.when(F.col("c_acctbal") < 0, " ").otherwise(F.concat(F.col("n_name"), F.lit(" "))).alias("attendance_city"),
        F.when(F.col("c_acctbal") < 0, "  ").when(F.col("c_acctbal") <= 9000, F.lower(segment)).alias("utm_source"),
        F.when(F.col("c_custkey") % 3 == 0, "Female").when(F.col("c_custkey") % 3 == 1, "Male").otherwise("")
        .alias("gender"),
        F.when(F.col("c_acctbal") >= -500, born).alias("dob"),
        form.alias("form_timestamp"),
        form.alias("updated_at"),
        F.to_date(F.date_trunc("quarter", form)).alias("session_on"),
        F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, "Morning").otherwise(" evening")
        .alias("session_label"),
    )


REGS = """regs AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS event_id, c_name || '@Example.org' AS email,
    nullif(lower(trim(c_name || '@Example.org', ' ')), '') AS email_normalized, c_name AS full_name,
    'p' || c_custkey AS profile_name, lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS mobile,
    CASE c_mktsegment WHEN 'BUILDING' THEN ' College_Student' WHEN 'AUTOMOBILE' THEN 'student'
      WHEN 'MACHINERY' THEN 'Professional ' WHEN 'HOUSEHOLD' THEN c_mktsegment END AS occupation,
    CAST(c_custkey % 30 AS INTEGER) AS designation_years, c_mktsegment AS designation, n_name AS city,
    CASE WHEN n_nationkey % 5 = 0 THEN lower(r_name) ELSE r_name END AS state, r_name AS country,
    CASE WHEN c_acctbal < 0 THEN ' ' ELSE n_name || ' ' END AS attendance_city,
    CASE WHEN c_acctbal < 0 THEN '  ' WHEN c_acctbal <= 9000 THEN lower(c_mktsegment) END AS utm_source,
    CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE '' END AS gender,
    CASE WHEN c_acctbal >= -500 THEN DATE '1960-02-29' + CAST(c_custkey % 14000 AS INTEGER) END AS dob,
    CASE WHEN c_acctbal >= -900
      THEN TIMESTAMP '1995-01-01 00:00:00' + to_seconds((c_custkey * 86413) % 207360000) END AS form_timestamp,
    CAST(date_trunc('quarter', CASE WHEN c_acctbal >= -900
      THEN TIMESTAMP '1995-01-01 00:00:00' + to_seconds((c_custkey * 86413) % 207360000) END) AS DATE) AS session_on,
    CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Morning' ELSE ' evening' END AS session_label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- submissions -----------------------------------------------------------------------------


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Virtual track: one round per calendar year."""
    status, at = F.col("o_orderstatus"), F.col("o_orderdate")
    leader = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@Example.org"))
    scored = ~((status == "P") & (F.col("o_orderpriority") == "5-LOW"))
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(2).alias("event_id"),
        (F.year(at) - 1994).alias("challenge_id"),
        F.when(status != "P", F.col("o_custkey")).alias("registration_id"),
        F.concat(F.lit("Team "), F.col("o_orderkey").cast("string")).alias("team_name"),
        F.concat(F.lit("Leader "), F.col("o_custkey").cast("string")).alias("leader_name"),
        leader.alias("leader_email"),
        F.lower(leader).alias("leader_email_normalized"),
        F.when(status != "P", F.dayofmonth(at) % 5).cast("int").alias("attempts_completed"),
        F.when(scored, F.col("o_totalprice").cast("decimal(14,4)")).alias("total_score"),
        F.when(status == "F", F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")))
        .when(status == "O", "  ").alias("deployed_link"),
        at.alias("export_created_at"),
        (at + F.expr("INTERVAL 1 DAY")).alias("imported_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "warmup").otherwise("main").alias("sheet_kind"),
        F.to_date(F.date_trunc("quarter", at)).alias("session_on"),
        F.when(F.col("o_orderpriority") == "2-HIGH", " Morning").otherwise("").alias("session_label"),
        F.col("o_custkey").alias("leader_id"),
        status.alias("track"),
    )


SUBS = """subs AS (
  SELECT o_orderkey AS id, 2 AS event_id, CAST(year(o_orderdate) - 1994 AS INTEGER) AS challenge_id,
    CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS registration_id, 'Team ' || o_orderkey AS team_name,
    'Leader ' || o_custkey AS leader_name,
    'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@Example.org' AS leader_email,
    lower('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@Example.org') AS leader_email_normalized,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(day(o_orderdate) % 5 AS INTEGER) END AS attempts_completed,
    CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
      THEN CAST(o_totalprice AS DECIMAL(14,4)) END AS total_score,
    CASE o_orderstatus WHEN 'F' THEN 'https://example.org/' || o_orderkey WHEN 'O' THEN '  ' END AS deployed_link,
    o_orderdate AS export_created_at, o_orderdate + INTERVAL 1 DAY AS imported_at,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'warmup' ELSE 'main' END AS sheet_kind,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS session_on,
    CASE WHEN o_orderpriority = '2-HIGH' THEN ' Morning' ELSE '' END AS session_label,
    o_custkey AS leader_id, o_orderstatus AS track
  FROM orders)"""


def in_person_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """In-person track: a submission belongs to the leader's city, quarter and label."""
    places = read_table(spark, folder, "customer").join(
        read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("attendance_city"))
    return submissions(spark, folder).join(places, F.col("leader_id") == F.col("c_custkey")).drop("c_custkey").withColumn(
        "event_id", F.lit(1)
    )


IP_SUBS = """ip_subs AS (
  SELECT subs.* REPLACE (1 AS event_id), n_name AS attendance_city
  FROM subs JOIN customer ON leader_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def rounds(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("o_orderdate")
    return (
        read_table(spark, folder, "orders", ["o_orderdate"])
        .groupBy((F.year(at) - 1994).alias("id"))
        .agg(F.min(at).alias("opens_at"), F.max(at).alias("closes_at"))
        .select(
            "id",
            F.when(F.col("id") % 4 == 0, 1).otherwise(2).alias("event_id"),
            F.concat(F.lit("Round "), F.col("id").cast("string")).alias("title"),
            F.when(F.col("id") > 1, F.col("opens_at")).alias("opens_at"),
            "closes_at",
            F.when(F.col("id") % 3 == 0, "live").when(F.col("id") % 3 == 1, "draft").otherwise("closed").alias("status"),
        )
    )


ROUNDS = """rounds AS (
  SELECT id, CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END AS event_id, 'Round ' || id AS title, CASE WHEN id > 1 THEN opens_at END AS opens_at, closes_at,
    CASE id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'draft' ELSE 'closed' END AS status
  FROM (SELECT CAST(year(o_orderdate) - 1994 AS INTEGER) AS id, min(o_orderdate) AS opens_at,
          max(o_orderdate) AS closes_at FROM orders GROUP BY 1))"""


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """In-person sessions: every (city, quarter, label) played; the id is a digest-free natural number."""
    subs = in_person_submissions(spark, folder)
    return subs.groupBy(
        F.lower(F.trim("attendance_city")).alias("city"), "session_on", F.trim("session_label").alias("session_label")
    ).agg(F.min("id").alias("id")).withColumn("event_id", F.lit(1))


SESSIONS = """sessions AS (
  SELECT lower(trim(attendance_city, ' ')) AS city, session_on, trim(session_label, ' ') AS session_label, min(id) AS id,
    1 AS event_id
  FROM ip_subs GROUP BY 1, 2, 3)"""


# --- events ----------------------------------------------------------------------------------


def signups(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamped registrations: every event is one."""
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("participant_id"), F.col("ts").alias("form_timestamp")
    )


SIGNUPS = """signups AS (
  SELECT event_id AS id, user_id AS participant_id, ts AS form_timestamp FROM events)"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("participant_id"),
        F.col("event_type").alias("challenge_id"),
        F.col("value").cast("decimal(14,4)").alias("delta"),
        F.col("ts").alias("created_at"),
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyyMMdd"))
        .alias("idempotency_key"),
    )


LEDGER = """ledger AS (
  SELECT event_id AS id, user_id AS participant_id, event_type AS challenge_id,
    CAST(value AS DECIMAL(14,4)) AS delta, ts AS created_at,
    concat_ws('-', CAST(user_id AS VARCHAR), event_type, strftime(ts, '%Y%m%d')) AS idempotency_key FROM events)"""


def enrolled(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("participant_id"))


def programmes(spark: SparkSession, folder: str) -> DataFrame:
    """Event 1 is in person, event 2 virtual."""
    return spark.createDataFrame([(1, "in_person"), (2, "virtual")], "id int, kind string")


PROGRAMMES = "programmes AS (SELECT * FROM (VALUES (1, 'in_person'), (2, 'virtual')) p(id, kind))"


ENROLLED = "enrolled AS (SELECT c_custkey AS participant_id FROM customer)"


def activity(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    path = F.concat(
        F.when(kind == "view", "/virtual/").when(kind == "click", "/in-person/").when(kind == "purchase", "/api/")
        .otherwise("/"),
        kind,
    )
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("occurred_at"),
        F.when(kind == "view", "VIEW").otherwise(F.upper(kind)).alias("action"),
        path.alias("url"),
        path.alias("endpoint"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("principal"),
        F.col("value").cast("decimal(12,3)").alias("latency_ms"),
        F.lit("registration").alias("entity"),
        F.concat(F.lit('{"id":'), F.col("user_id").cast("string"), F.lit("}")).alias("record_pk"),
        F.col("props").alias("extra"),
    )


ACTIVITY = """activity AS (
  SELECT event_id AS id, ts AS occurred_at, CASE event_type WHEN 'view' THEN 'VIEW' ELSE upper(event_type) END AS action,
    CASE event_type WHEN 'view' THEN '/virtual/' WHEN 'click' THEN '/in-person/' WHEN 'purchase' THEN '/api/'
      ELSE '/' END || event_type AS url,
    'user-' || user_id AS principal, user_id, CAST(value AS DECIMAL(12,3)) AS latency_ms, props AS extra
  FROM events)"""


PARTS = {
    "regs": ("", REGS), "subs": ("", SUBS), "ip_subs": ("subs", IP_SUBS), "rounds": ("", ROUNDS),
    "sessions": ("ip_subs", SESSIONS), "signups": ("", SIGNUPS), "ledger": ("", LEDGER),
    "enrolled": ("", ENROLLED), "programmes": ("", PROGRAMMES), "activity": ("", ACTIVITY),
}


def with_parts(names: tuple[str, ...]) -> str:
    """WITH clause holding the named parts and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, text = PARTS[name]
        if needs:
            add(needs)
        if text not in ordered:
            ordered.append(text)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(ordered) + "\n" if ordered else ""
