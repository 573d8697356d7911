"""Files, tabs and payloads, made by Spark from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import query
from turnout.functions.dates import parse_timestamp_text, unparsed
from turnout.functions.numbers import attempts_from_text, float_from_text, int_from_text
from turnout.functions.text import split_trailing_years
from turnout.session import shared_folder
from turnout.sources.files import file_manifest, listed_files, read_csv_records, read_csv_strings, spread, whole_manifest, with_status
from turnout.sources.payloads import extract_records_json, map_registration_records, parse_rsvp_snapshot
from turnout.sources.sheets import dedupe_submissions, parse_registrations, parse_submissions
from turnout.sources.tabs import route_tabs_to_kind, route_tabs_to_rounds


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/turnout-{uuid.uuid4().hex}"


# --- CSV ----------------------------------------------------------------------------------------


@query("""SELECT trim(email, ' ') AS email, trim(full_name, ' ') AS full_name, coalesce(strftime(form_timestamp - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S'), '') AS at,
  CASE WHEN trim(utm_source, ' ') <> '' THEN trim(utm_source, ' ') END AS utm_source, trim(city, ' ') AS city,
  nullif(trim(designation, ' '), '') AS designation,
  CASE WHEN designation IS NOT NULL THEN designation_years END AS designation_years, strftime(dob, '%Y-%m-%d') AS dob,
  strftime(session_on, '%Y-%m-%d') AS session_on, trim(session_label, ' ') AS session_label FROM regs""", "regs")
def csv_registrations(spark: SparkSession, folder: str) -> DataFrame:
    """Registrations written as CSV with the form's headers, then parsed; naive times are business time."""
    cells = base.registrations(spark, folder).select(
        F.date_format("form_timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.concat(F.lit("  "), "email").alias("Email"),
        F.col("full_name").alias("Full  Name"),
        F.col("utm_source").alias("UTM Source"),
        F.col("city").alias("City"),
        F.col("designation_raw").alias("Designation (Year of Exp.)"),
        F.date_format("dob", "yyyy-MM-dd").alias("Date of Birth"),
        F.date_format("session_on", "yyyy-MM-dd").alias("Programme Date"),
        F.col("session_label").alias("PW Session"),
        F.lit("ignored").alias("Unknown column"),
    )
    path = scratch(spark)
    cells.write.option("header", True).csv(path)
    rows, _ = parse_registrations(read_csv_strings(spark, path), programmes=["Programme"])
    return rows.select(
        "email", "full_name",
        F.coalesce(F.date_format("form_timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"),
        "utm_source", "city", "designation", "designation_years", F.date_format("dob", "yyyy-MM-dd").alias("dob"),
        F.date_format("session_on", "yyyy-MM-dd").alias("session_on"), "session_label",
    )


@query("""SELECT doc_id, md5(coalesce(replace(text, '. ', '.' || chr(10)), '') || '"' || chr(10)) AS cell, coalesce(source, '') AS source FROM documents""")
def csv_broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as CSV with a line break after every sentence and a quote at the end, read back by files split at any line."""
    cells = base.read_table(spark, folder, "documents", ["doc_id", "text", "source"]).select(
        F.col("doc_id").alias("Id"),
        F.concat(F.coalesce(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit("")), F.lit('"\n')).alias("Text"),
        F.col("source").alias("Source"))
    path = scratch(spark)
    # Blanks at both ends of a cell belong to it.
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells.write.options(header="true", escape='"', **keep).csv(path)
    return read_csv_records(spark, path).select(
        F.col("Id").cast("long").alias("doc_id"), F.md5("Text").alias("cell"), F.coalesce("Source", F.lit("")).alias("source"))


@query("""WITH cells AS (SELECT o_orderkey, o_orderpriority AS tab, 'Customer#' || o_custkey AS email,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Team ' || o_custkey END AS team, o_totalprice FROM orders)
  SELECT tab, email AS leader_email, first(o_totalprice ORDER BY o_orderkey DESC) AS total_score,
    max(o_orderkey) AS row_no FROM cells WHERE team <> '' GROUP BY 1, 2""")
def sheet_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows as sheet cells under the sheet's headers: typed, filtered, last row per round and leader."""
    raw = base.read_table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("tab"),
        F.col("o_orderkey").alias("row_no"),
        F.concat(F.lit(" Customer#"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("Leader Email"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit("Team "), F.col("o_custkey").cast("string")))
        .alias("﻿Team   NAME"),
        F.format_number("o_totalprice", 2).alias("Total Score (Latest Attempt)"),
    )
    rows, _ = parse_submissions(raw, keep=["tab", "row_no"])
    last = dedupe_submissions(rows, ["tab"], order=["row_no"])
    return last.select("tab", "leader_email", "total_score", "row_no")


@query("""SELECT tab, count(*) AS rows_read, count(*) FILTER (team <> '') AS rows_valid FROM (
  SELECT o_orderpriority AS tab, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Team' END AS team FROM orders) GROUP BY 1""")
def sheet_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    raw = base.read_table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("tab"),
        F.lit("a@b.org").alias("Leader Email"),
        F.when(F.col("o_orderstatus") != "P", "Team").alias("Team Name"),
    )
    return parse_submissions(raw, keep=["tab"])[1]


@query("""SELECT tab, n, CASE WHEN tab LIKE '%URGENT%' THEN 1 WHEN tab LIKE '%HIGH%' THEN 2 WHEN tab LIKE '%MEDIUM%' THEN 3
    END AS challenge_id, CASE WHEN tab LIKE '%LOW%' THEN 'no round matches' WHEN tab NOT LIKE '%Submission%'
    THEN 'not a submission tab' END AS reason
  FROM (SELECT CASE WHEN o_orderpriority LIKE '4%' THEN 'Summary ' || o_orderpriority
    ELSE left(o_orderpriority, 1) || '.  Submission ' || substr(o_orderpriority, 3) END AS tab, count(*) AS n
    FROM orders GROUP BY 1)""")
def tab_routing(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    tabs = base.read_table(spark, folder, "orders", ["o_orderpriority"]).groupBy(
        F.when(priority.startswith("4"), F.concat(F.lit("Summary "), priority)).otherwise(
            F.concat(F.substring(priority, 1, 1), F.lit(".  Submission "), priority.substr(F.lit(3), F.length(priority)))
        ).alias("tab")
    ).agg(F.count(F.lit(1)).alias("n"))
    rounds = spark.createDataFrame(
        [(1, "First", " urgent "), (2, "HIGH", None), (3, "Medium", "")],
        "id int, title string, import_sheet_suffix string",
    )
    routed, errors = route_tabs_to_rounds(tabs, "tab", rounds)
    return routed.withColumn("reason", F.lit(None).cast("string")).unionByName(
        errors.withColumn("challenge_id", F.lit(None).cast("int"))
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'warmup' ELSE 'main' END AS sheet_kind FROM orders
  WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'""")
def tab_kinds(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    tabs = base.read_table(spark, folder, "orders", ["o_orderkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("id"),
        F.when(priority.startswith("1"), "1.Warm-up   Challenge").when(priority.startswith("2"), "2) Challenge 7 Submission")
        .otherwise("Summary").alias("tab"),
    )
    return route_tabs_to_kind(tabs, "tab")[0].drop("tab")


@query("""SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS INTEGER) AS whole, o_totalprice AS number,
    CASE WHEN trunc(o_totalprice - 2000) >= 1 THEN CAST(trunc(o_totalprice - 2000) AS INTEGER) END AS attempts FROM orders""")
def numbers_from_text(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.format_number("o_totalprice", 2))
    less = F.format_number(F.col("o_totalprice") - 2000, 2)
    return base.read_table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("id"), int_from_text(text).alias("whole"), float_from_text(text).alias("number"),
        attempts_from_text(less).alias("attempts"),
    )


@query("""SELECT event_id AS id, strftime(CASE event_id % 8 WHEN 1 THEN ts + INTERVAL 150 MINUTE WHEN 2 THEN ts
    WHEN 7 THEN NULL ELSE CASE event_id % 8 WHEN 0 THEN ts WHEN 3 THEN date_trunc('second', ts)
      WHEN 6 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE date_trunc('minute', ts) END - INTERVAL 330 MINUTE END,
    '%Y-%m-%d %H:%M:%S.%f') AS at, event_id % 8 = 7 AS lost FROM events""")
def timestamps_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """Eight ways to write a time: three ISO forms, month first, names of months, day first, a bare day, and none."""
    which = F.col("event_id") % 8
    wall = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    # Slashes are read month first where that is a date; a day after the twelfth says that it stands first.
    slashed = F.when(F.dayofmonth("ts") > 12, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm"))
    text = (
        F.when(which == 0, wall).when(which == 1, F.concat(wall, F.lit("-02:30")))
        .when(which == 2, F.concat(F.replace(wall, F.lit(" "), F.lit("T")), F.lit("Z")))
        .when(which == 3, F.date_format("ts", "M/d/yyyy H:mm:ss")).when(which == 4, F.date_format("ts", "MMM d, yyyy h:mm a"))
        .when(which == 5, slashed).when(which == 6, F.date_format("ts", "yyyy/MM/dd")).otherwise("soon")
    )
    events = base.read_table(spark, folder, "events", ["event_id", "ts"]).select(F.col("event_id").alias("id"), text.alias("cell"))
    parsed = events.withColumn("at", parse_timestamp_text("cell"))
    return parsed.select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), unparsed("cell", "at").alias("lost"))


@query("""SELECT c_custkey AS id, nullif(trim(CASE WHEN c_custkey % 4 = 0
      THEN c_mktsegment || ' (x) lead' ELSE c_mktsegment END, ' '), '') AS designation,
    CASE WHEN c_custkey % 4 <> 1 AND c_mktsegment IS NOT NULL THEN CAST(c_custkey % 30 AS INTEGER) END AS years FROM customer""")
def split_designation(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    tail = F.concat(F.lit(" ( "), (key % 30).cast("string"), F.lit(" ) "))
    text = (
        F.when(key % 4 == 0, F.concat("c_mktsegment", F.lit(" (x) lead"), tail)).when(key % 4 == 1, F.col("c_mktsegment"))
        .otherwise(F.concat("c_mktsegment", tail))
    )
    name, years = split_trailing_years(text)
    customer = base.read_table(spark, folder, "customer", ["c_custkey", "c_mktsegment"])
    return customer.select(key.alias("id"), name.alias("designation"), years.alias("years"))


# --- payloads -----------------------------------------------------------------------------------


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON payload per event, its shape by event type: list, data list, envelope, table, unknown; in tasks of bounded size."""
    kind = F.col("event_type")
    person = F.struct(
        F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.org ")).alias("E-Mail"),
        F.col("event_type").alias("Full Name"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'").alias("created_at"),
    )
    nobody = F.struct(F.lit("Nobody").alias("full_name"))
    both = F.concat(F.lit("["), F.to_json(person), F.lit(","), F.to_json(nobody), F.lit("]"))
    table = F.concat(
        F.lit('{"rows":[["email","name"],["user'), F.col("user_id").cast("string"), F.lit('@example.org","'), kind,
        F.lit('"]]}'),
    )
    text = (
        F.when(kind == "view", both)
        .when(kind == "click", F.concat(F.lit('{"ok":true,"data":'), both, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"event":{"registrations":'), both, F.lit("}}")))
        .when(kind == "signup", table)
        .otherwise(F.lit('{"message":"none"}'))
    )
    return spread(base.read_table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type"])).select(
        F.col("event_id").alias("payload_no"), text.alias("payload"))


@query("""SELECT event_id AS payload_no, CASE event_type WHEN 'signup' THEN 'user' ELSE 'User' END || user_id || '@'
    || CASE event_type WHEN 'signup' THEN 'example.org' ELSE 'Example.org' END AS email, event_type AS full_name,
    CASE WHEN event_type <> 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS form_timestamp
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')""")
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    records, _ = extract_records_json(payloads(spark, folder), "payload")
    rows, _ = map_registration_records(records)
    return rows.select(
        "payload_no", "email", "full_name", F.date_format("form_timestamp", "yyyy-MM-dd HH:mm:ss").alias("form_timestamp")
    )


@query("""SELECT event_id AS payload_no, 'missing email' AS reason FROM events
  WHERE event_type IN ('view', 'click', 'purchase') UNION ALL
  SELECT event_id, 'no records' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')""")
def json_rejects(spark: SparkSession, folder: str) -> DataFrame:
    records, unknown = extract_records_json(payloads(spark, folder), "payload", both=True)
    _, rejects = map_registration_records(records)
    return rejects.select("payload_no", "reason").unionByName(
        unknown.select("payload_no", F.lit("no records").alias("reason"))
    )


@query("""SELECT o_orderkey AS payload_no, lower(o_orderpriority) || o_custkey || '@example.org' AS email, o_orderstatus AS full_name,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Pune' END AS city FROM orders""")
def json_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tables in JSON: columns with data, headers with rows, or a first row that names the columns; short rows lack their last cells."""
    key = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("E-mail", "Full Name", "City")))
    address = F.concat(F.lower("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit("@example.org"))
    full = F.array(address, "o_orderstatus", F.lit("Pune"))
    row = F.when(key % 3 == 0, F.slice(full, 1, 2)).otherwise(full)
    shaped = (
        F.when(key % 2 == 0, F.to_json(F.struct(names.alias("columns"), F.array(row).alias("data"))))
        .otherwise(F.to_json(F.struct(F.array(names, row).alias("rows"))))
    )
    orders = spread(base.read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]))
    records, _ = extract_records_json(orders.select(key.alias("payload_no"), shaped.alias("payload")), "payload")
    return map_registration_records(records)[0].select("payload_no", "email", "full_name", "city")


@query("""SELECT o_orderkey AS id, o_orderpriority AS external_event_tag, CAST(o_orderkey AS INTEGER) AS rsvp_invite_sent,
    CAST(o_custkey AS INTEGER) AS rsvp_accepted, 'c' || o_custkey AS checked_in FROM orders""")
def rsvp_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    payload = F.to_json(
        F.struct(
            F.struct(F.col("o_orderpriority").alias("eventTag")).alias("event"),
            F.struct(F.col("o_orderkey").alias("rsvpInviteSent"), F.col("o_custkey").alias("rsvpAccepted")).alias("stats"),
            F.struct(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("checkedInParticipants"))
            .alias("statsEmails"),
        )
    )
    orders = base.read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), payload.alias("payload"))
    return parse_rsvp_snapshot(orders, "payload").select(
        "id", "external_event_tag", "rsvp_invite_sent", "rsvp_accepted",
        F.col("stats_emails")["checkedInParticipants"][0].alias("checked_in"),
    )


@query("""SELECT 'nation.parquet' AS file_name, count(*) AS n_rows, CAST(sum(('0x' || substr(md5(concat_ws(chr(31),
      n_nationkey, n_name, n_regionkey)), 1, 15))::HUGEINT) % 1152921504606846976 AS BIGINT) AS digest,
    'tables' AS module, 'received' AS status FROM nation
  UNION ALL SELECT 'customer.parquet', count(*), CAST(sum(('0x' || substr(md5(concat_ws(chr(31), c_custkey, c_name,
      coalesce(c_mktsegment, '\\N'))), 1, 15))::HUGEINT) % 1152921504606846976 AS BIGINT), 'tables', 'loaded' FROM customer""")
def file_manifest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of two of the input files; a later step reports one of them as loaded."""
    listed = [
        file_manifest(base.read_table(spark, folder, name), "tables", columns) for name, columns in
        (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("customer", ["c_custkey", "c_name", "c_mktsegment"]))
    ]
    done = spark.createDataFrame([("customer.parquet", "loaded")], "file_name string, status string")
    return with_status(listed[0].unionByName(listed[1]), done).drop("size_bytes")


#: Every table of the folder with all its columns, and how the SQL writes those that the two systems print differently.
TABLES = {
    "benchmark": "item_id text", "conversations": "conv_id turn role text", "customer": "c_custkey c_name c_nationkey c_acctbal:n c_mktsegment",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:v label", "events": "event_id ts:t user_id event_type value:n props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag l_linestatus l_shipdate:t",
    "nation": "n_nationkey n_name n_regionkey", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:n o_orderdate:t o_orderpriority",
    "pages": "page_id url html", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:n", "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:n",
}


def _manifest_sql(table: str) -> str:
    # Numbers with a fraction are told apart to the ninth decimal, components of vectors likewise; moments by their microseconds.
    write = {"": "{0}", "t": "epoch_us({0})", "n": "CAST(floor({0} * 1e9) AS HUGEINT)",
             "v": "array_to_string(list_transform({0}, lambda x: coalesce(CAST(CAST(floor(x::DOUBLE * 1e9) AS HUGEINT) AS VARCHAR), '\\N')), ',')"}
    cells = ", ".join("coalesce(CAST(" + write[kind].format(c) + " AS VARCHAR), '\\N')" for c, _, kind in (x.partition(":") for x in TABLES[table].split()))
    return f"""SELECT '{table}.parquet' AS file_name, count(*) AS n_rows, CAST(coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {cells})), 1, 15))::HUGEINT), 0)
      % 1152921504606846976 AS BIGINT) AS digest, 'tables' AS module, '{"loaded" if table == "customer" else "received"}' AS status FROM {table}"""


def _written(column: str, kind: str) -> Column:
    scaled = lambda x: F.floor(x.cast("double") * F.lit(1e9).cast("double")).cast("decimal(38,0)").cast("string")
    if kind == "v":
        return F.array_join(F.transform(column, lambda x: F.coalesce(scaled(x), F.lit("\\N"))), ",")
    if kind == "n":
        return scaled(F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp")) if kind == "t" else F.col(column)


@query(" UNION ALL ".join(map(_manifest_sql, TABLES)))
def file_manifest_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of every table of the folder over all columns, with a row also for a table of no rows; customer is reported as loaded."""
    listed = None
    for table, columns in TABLES.items():
        path = f"{folder}/{table}.parquet"
        pairs = [x.partition(":") for x in columns.split()]
        rows = base.read_table(spark, folder, table).select(*(_written(c, kind).alias(c) for c, _, kind in pairs), "_metadata")
        one = whole_manifest(rows, listed_files(spark, path), "tables", [c for c, _, _ in pairs])
        listed = one if listed is None else listed.unionByName(one)
    done = spark.createDataFrame([("customer.parquet", "loaded")], "file_name string, status string")
    return with_status(listed, done).drop("size_bytes")
