"""Activity and change log queries, and bootcamp sessions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import query
from turnout.catalog.writing import _VERSIONS, _current, _incoming
from turnout.functions.classify import activity_source, module_of_path, sql_kind
from turnout.operators.changes import diff_changes, with_context
from turnout.operators.resolve import bootcamp_rules, email_list, session_date_rules, validate_rows
from turnout.operators.sessions import default_session
from turnout.plans.activity import (
    activity_search,
    change_search,
    distinct_actions,
    log_page,
    record_timeline,
    since,
)
from turnout.plans.bootcamp import bootcamp_history, bootcamp_tiles

_NOW = datetime(2024, 1, 25)


@query("""SELECT row_number() OVER (ORDER BY occurred_at DESC, id DESC) AS row, id, action, principal,
    strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM activity
  WHERE occurred_at >= TIMESTAMP '2024-01-18' AND action = 'VIEW' AND (action ILIKE '%k": 7%' OR url ILIKE '%k": 7%'
    OR principal ILIKE '%k": 7%' OR extra ILIKE '%k": 7%') QUALIFY row <= 50""", "activity")
def activity_search_page(spark: SparkSession, folder: str) -> DataFrame:
    log = base.activity(spark, folder)
    found = activity_search(log, q='k": 7', action="VIEW", start=since(_NOW, 168))
    return log_page(found, "id").select(
        "row", "id", "action", "principal", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at")
    )


@query("""SELECT count(*) AS n FROM activity WHERE occurred_at >= TIMESTAMP '2024-01-18' AND (action ILIKE '%user-1%'
  OR url ILIKE '%user-1%' OR principal ILIKE '%user-1%' OR extra ILIKE '%user-1%')""", "activity")
def activity_search_total(spark: SparkSession, folder: str) -> DataFrame:
    found = activity_search(base.activity(spark, folder), q="user-1", start=since(_NOW, 168))
    return found.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT action FROM activity WHERE occurred_at >= TIMESTAMP '2024-01-18'", "activity")
def distinct_action_list(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_actions(base.activity(spark, folder), since(_NOW, 168))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    diff = diff_changes(_current(spark, folder), _incoming(spark, folder), ["id"])
    return with_context(diff, "registrations", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(_VERSIONS + """, j AS (SELECT CASE WHEN c.id IS NULL THEN 'INSERT' WHEN i.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END
    AS op, coalesce(c.id, i.id) AS id, concat_ws(',', CASE WHEN c.name IS DISTINCT FROM i.name THEN c.name || ' ' ||
      coalesce(i.name, '') END, CASE WHEN c.segment IS DISTINCT FROM i.segment THEN c.segment || ' ' || i.segment END)
      AS changed FROM cur c FULL JOIN inc i ON c.id = i.id)
  SELECT op, '{"id":' || id || '}' AS record_pk FROM j
  WHERE '{"id":' || id || '}' ILIKE '%building%' OR (op = 'UPDATE' AND changed ILIKE '%building%')""")
def change_search_rows(spark: SparkSession, folder: str) -> DataFrame:
    return change_search(_changes(spark, folder), "building").select("op", "record_pk")


@query(_VERSIONS + """, first_user AS (SELECT min(user_id) AS u FROM events WHERE event_type = 'view'),
  j AS (SELECT CASE WHEN c.id IS NULL THEN 'INSERT' WHEN i.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
    concat_ws(', ', CASE WHEN c.name IS DISTINCT FROM i.name THEN 'name' END,
      CASE WHEN c.segment IS DISTINCT FROM i.segment THEN 'segment' END,
      CASE WHEN c.balance IS DISTINCT FROM i.balance THEN 'balance' END) AS cols
    FROM cur c FULL JOIN inc i ON c.id = i.id WHERE coalesce(c.id, i.id) = 7),
  data AS (SELECT TIMESTAMP '2024-01-10' AS t, 'data' AS kind, op, CASE op WHEN 'INSERT' THEN 'Registration row inserted'
    WHEN 'DELETE' THEN 'Registration row deleted' ELSE 'Updated: ' || cols END AS summary FROM j),
  seen AS (SELECT ts AS t, 'event' AS kind, 'VIEW' AS op, 'Detail viewed — /virtual/view' AS summary FROM events
    WHERE event_type = 'view' AND user_id = 7 ORDER BY ts LIMIT 100)
  SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS occurred_at, kind, op, summary
  FROM (SELECT * FROM data UNION ALL SELECT * FROM seen) ORDER BY t LIMIT 250""")
def record_timeline_rows(spark: SparkSession, folder: str) -> DataFrame:
    views = base.activity(spark, folder).withColumn("module", module_of_path("url"))
    rows = record_timeline(_changes(spark, folder), views, "registrations", "registration", "virtual", 7)
    return rows.select(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "kind", "op", "summary")


@query("""SELECT CASE event_type WHEN 'view' THEN 'virtual' WHEN 'click' THEN 'in_person' WHEN 'purchase' THEN 'api'
    ELSE 'overview' END AS module, CASE event_type WHEN 'purchase' THEN 'api' ELSE 'ui' END AS source,
    CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT'
      WHEN 'signup' THEN 'DDL' ELSE 'TXN' END AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def activity_classes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("action")
    statement = (
        F.when(kind == "VIEW", "-- who\n select 1").when(kind == "CLICK", "WITH a AS (SELECT 1) SELECT * FROM a")
        .when(kind == "PURCHASE", "/* log */ insert into t values (1)").when(kind == "SIGNUP", "Alter table t add c int")
        .otherwise("commit")
    )
    return base.activity(spark, folder).groupBy(
        module_of_path("url").alias("module"), activity_source("url").alias("source"), sql_kind(statement).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- bootcamp: one session per supplier nation, month and half of the day ---------------------------


def _bootcamp(spark: SparkSession, folder: str) -> DataFrame:
    lines = base.read_table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    supplier = base.read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = base.read_table(spark, folder, "nation").select("n_nationkey", F.lower("n_name").alias("city"))
    flag = F.col("l_returnflag")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            "city", F.to_date(F.date_trunc("month", "l_shipdate")).alias("bootcamp_on"),
            F.when(F.col("l_quantity") < 25, "morning").otherwise("evening").alias("slot"),
        )
        .agg(
            F.count(F.lit(1)).alias("attendees"), F.sum("l_quantity").cast("long").alias("activations"),
            F.count(F.when(flag == "R", 1)).alias("students"), F.count(F.when(flag == "N", 1)).alias("professionals"),
        )
    )


_BOOTCAMP = """WITH bootcamp AS (SELECT lower(n_name) AS city, CAST(date_trunc('month', l_shipdate) AS DATE) AS bootcamp_on,
    CASE WHEN l_quantity < 25 THEN 'morning' ELSE 'evening' END AS slot, count(*) AS attendees,
    CAST(sum(l_quantity) AS BIGINT) AS activations, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS students,
    count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS professionals
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3)"""


@query(_BOOTCAMP + """ SELECT upper(city[1]) || replace(city[2:], '_', ' ') || ' · ' || strftime(bootcamp_on, '%d %b %Y') ||
  ' · ' || CASE slot WHEN 'morning' THEN 'Morning' ELSE 'Evening' END AS batch_label, activations, city,
  strftime(bootcamp_on, '%Y-%m-%d') AS bootcamp_on, slot FROM bootcamp""")
def bootcamp_history_rows(spark: SparkSession, folder: str) -> DataFrame:
    return bootcamp_history(_bootcamp(spark, folder)).withColumn("bootcamp_on", F.date_format("bootcamp_on", "yyyy-MM-dd"))


@query(_BOOTCAMP + """ SELECT CAST(coalesce(sum(attendees), 0) AS BIGINT) AS attendees,
  CAST(coalesce(sum(activations), 0) AS BIGINT) AS activations, CAST(coalesce(sum(students), 0) AS BIGINT) AS students,
  CAST(coalesce(sum(professionals), 0) AS BIGINT) AS professionals
  FROM bootcamp WHERE city = 'nation_3' AND bootcamp_on = DATE '1999-05-01' AND slot = 'evening'""")
def bootcamp_session_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return bootcamp_tiles(_bootcamp(spark, folder), "Nation_3 ", "1999-05-01", "evening")


@query(_BOOTCAMP + """ SELECT city, strftime(bootcamp_on, '%Y-%m-%d') AS bootcamp_on, slot FROM bootcamp
  WHERE bootcamp_on <= DATE '1999-05-20' ORDER BY bootcamp.bootcamp_on DESC, city || slot DESC LIMIT 1""")
def bootcamp_default_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = _bootcamp(spark, folder).withColumn("key", F.concat("city", "slot"))
    pick = default_session(rows, "bootcamp_on", date(1999, 5, 20), "key")
    return pick.select("city", F.date_format("bootcamp_on", "yyyy-MM-dd").alias("bootcamp_on"), "slot")


# --- validation -------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN ' ' ELSE 'pune' END AS city,
    CASE WHEN l_discount = 0 THEN NULL WHEN l_discount = 0.01 THEN DATE '1970-01-01' ELSE CAST(l_shipdate AS DATE) END AS d,
    l_returnflag AS slot, CAST(l_quantity AS INTEGER) - 2 AS seats FROM lineitem)
  SELECT error, count(*) AS n FROM (
    SELECT 'city is required' AS error FROM r WHERE trim(city, ' ') = ''
    UNION ALL SELECT 'bootcamp_on must be a valid date' FROM r WHERE d IS NULL
    UNION ALL SELECT '1970-01-01 is not a valid session date' FROM r WHERE d = DATE '1970-01-01'
    UNION ALL SELECT 'slot must be morning or evening' FROM r WHERE lower(slot) NOT IN ('a')
    UNION ALL SELECT 'capacity must be >= 0' FROM r WHERE seats < 0) GROUP BY 1""")
def validate_rows_errors(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.read_table(spark, folder, "lineitem").select(
        F.when(F.col("l_quantity") < 3, " ").otherwise("pune").alias("city"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("date"))
        .when(F.col("l_discount") == 0.01, F.lit("1970-01-01").cast("date"))
        .otherwise(F.to_date("l_shipdate")).alias("bootcamp_on"),
        # The flag A stands for a morning session, the others for no known slot.
        F.when(F.col("l_returnflag") == "A", "am").otherwise(F.col("l_returnflag")).alias("slot"),
        (F.col("l_quantity").cast("int") - 2).alias("capacity"),
    )
    _, rejects = validate_rows(rows, bootcamp_rules(["capacity"]))
    return rejects.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS rejected FROM regs WHERE session_on IS NULL AND trim(session_label, ' ') <> ''""", "regs")
def session_date_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, rejects = validate_rows(base.registrations(spark, folder), session_date_rules("session_on", "session_label"))
    return rejects.agg(F.count(F.lit(1)).alias("rejected"))


@query("""WITH a AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '  '
    WHEN o_orderstatus = 'P' THEN 'customer ' || o_custkey || '@x.org' WHEN o_orderstatus = 'O' THEN ' C' || o_custkey || '@X.org '
    ELSE 'c' || o_custkey || '@x.org' END AS e FROM orders)
  SELECT count(*) AS rows_read, count(*) FILTER (trim(e, ' ') = '') AS rows_blank_email,
    count(*) FILTER (trim(e, ' ') <> '' AND contains(trim(e, ' '), ' ')) AS rows_invalid_email,
    count(DISTINCT lower(trim(e, ' '))) FILTER (trim(e, ' ') <> '' AND NOT contains(trim(e, ' '), ' ')) AS rows_after_dedupe
  FROM a""")
def valid_email_stats(spark: SparkSession, folder: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    cell = (
        F.when((status == "P") & (F.col("o_orderpriority") == "5-LOW"), "  ")
        .when(status == "P", F.concat(F.lit("customer "), key, F.lit("@x.org")))
        .when(status == "O", F.concat(F.lit(" C"), key, F.lit("@X.org ")))
        .otherwise(F.concat(F.lit("c"), key, F.lit("@x.org")))
    )
    return email_list(base.read_table(spark, folder, "orders").select(cell.alias("address")), "address")[1]


