"""Merges, patches, links, duplicates, grants and change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import query
from turnout.operators.changes import diff_changes
from turnout.operators.dedupe import dedupe_stats, keep_first, keep_last, keep_latest_and_repoint
from turnout.operators.merge import (
    append_idempotent,
    count_actions,
    insert_if_absent,
    patch_column,
    relink_by_natural_key,
    replace_slice,
    unlink_then_delete,
    unmatched_report,
    upsert,
)
from turnout.operators.resolve import best_match, missing_references, resolve_required, scope_gate
from turnout.plans.ledger import grant_credits

# Two versions of the customer table: the incoming one lacks some rows, adds shifted ones and
# changes or empties some values.
_VERSIONS = """WITH cur AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment,
    CAST(c_acctbal AS DECIMAL(14,4)) AS balance FROM customer),
  inc AS (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS id,
    CASE WHEN c_acctbal < 3000 THEN NULL ELSE upper(c_name) END AS name,
    CASE WHEN c_acctbal < 6000 THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment,
    CAST(100 AS DECIMAL(14,4)) AS balance FROM customer WHERE c_acctbal < 8000)"""


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return base.read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(14,4)").alias("balance"),
    )


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("c_acctbal")
    return base.read_table(spark, folder, "customer").where(amount < 8000).select(
        F.when(amount < 0, F.col("c_custkey") + 1000000000).otherwise(F.col("c_custkey")).alias("id"),
        F.when(amount >= 3000, F.upper("c_name")).alias("name"),
        F.when(amount < 6000, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("segment"),
        F.lit(100).cast("decimal(14,4)").alias("balance"),
    )


def _merged_sql(name: str, balance: str) -> str:
    return _VERSIONS + f""" SELECT coalesce(c.id, i.id) AS id, {name} AS name,
    CASE WHEN i.id IS NOT NULL THEN i.segment ELSE c.segment END AS segment, CAST({balance} AS DOUBLE) AS balance,
    CASE WHEN i.id IS NULL THEN 'keep' WHEN c.id IS NULL THEN 'insert' ELSE 'update' END AS _action
  FROM cur c FULL JOIN inc i ON c.id = i.id"""


def _as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("balance", F.col("balance").cast("double"))


@query(_merged_sql("CASE WHEN i.id IS NOT NULL THEN i.name ELSE c.name END",
                   "CASE WHEN i.id IS NOT NULL THEN i.balance ELSE c.balance END"))
def upsert_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(upsert(_current(spark, folder), _incoming(spark, folder), ["id"]))


@query(_merged_sql("coalesce(i.name, c.name)", "CASE WHEN i.id IS NOT NULL THEN i.balance ELSE c.balance END"))
def upsert_keep_if_null(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(upsert(_current(spark, folder), _incoming(spark, folder), ["id"], keep_if_null=["name"]))


@query(_merged_sql("CASE WHEN i.id IS NOT NULL THEN i.name ELSE c.name END",
                   "CASE WHEN i.id IS NULL THEN c.balance ELSE i.balance + coalesce(c.balance, 0) END"))
def upsert_additive(spark: SparkSession, folder: str) -> DataFrame:
    return _as_double(upsert(_current(spark, folder), _incoming(spark, folder), ["id"], additive=["balance"]))


@query("SELECT _action AS action, count(*) AS n FROM (" + _merged_sql("c.name", "c.balance") + ") GROUP BY 1")
def upsert_action_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_actions(upsert(_current(spark, folder), _incoming(spark, folder), ["id"]))


@query(_VERSIONS + """ SELECT id, name, segment, CAST(balance AS DOUBLE) AS balance FROM cur
  UNION ALL SELECT id, name, segment, CAST(balance AS DOUBLE) FROM inc WHERE id NOT IN (SELECT id FROM cur)""")
def insert_absent_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = insert_if_absent(_current(spark, folder), _incoming(spark, folder), ["id"], ["segment"])
    return _as_double(out)


@query("""SELECT o_orderkey, o_custkey, coalesce(p.qty, CAST(0 AS BIGINT)) AS attempts FROM orders
  LEFT JOIN (SELECT l_orderkey, CAST(max_by(l_quantity, l_linenumber) AS BIGINT) AS qty FROM lineitem
    GROUP BY 1) p ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""")
def patch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder)[0].drop("o_orderstatus")


def _patched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Attempts of an order come from its lines; the last line number wins."""
    current = base.read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).withColumn(
        "attempts", F.lit(0).cast("long")
    )
    sheet = base.read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("attempts"), "l_linenumber",
        "l_suppkey", "l_partkey",
    )
    # Line numbers repeat within an order in these tables, so the rest of the row breaks ties.
    return patch_column(
        current, sheet, ["o_orderkey"], "attempts", ["l_linenumber", "l_partkey", "l_suppkey", "attempts"],
        F.col("o_orderstatus") != "P",
    )


base.ORACLE["patch_attempts"] = base.ORACLE["patch_attempts"].replace(
    "max_by(l_quantity, l_linenumber)",
    "first(l_quantity ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC)",
)


@query("""WITH bad AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN
    (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
  SELECT count(*) AS rows_not_matched, count(DISTINCT l_orderkey) AS keys_not_matched,
    (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS k FROM bad
      ORDER BY k LIMIT 80)) AS sample FROM bad""")
def patch_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    unmatched = _patched(spark, folder)[1].select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"))
    return unmatched_report(unmatched, "key", 80)


@query("""WITH inc AS (SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events
    WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-16'),
  cur AS (SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events)
  SELECT * FROM cur WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM inc)
  UNION ALL SELECT * FROM inc""")
def replace_slice_rows(spark: SparkSession, folder: str) -> DataFrame:
    current = base.read_table(spark, folder, "events").select(
        "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).distinct()
    incoming = current.where("event_type IN ('view', 'click') AND day >= '2024-01-16'")
    return replace_slice(current, incoming, ["user_id", "event_type"])


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents keyed by a digest of the whole text, so that the shuffle does not carry the text."""
    docs = base.read_table(spark, folder, "documents", ["doc_id", "text", "lang", "source"])
    return docs.withColumn("digest", F.sha2("text", 256)).drop("text")


@query("""SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""")
def dedupe_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    return keep_last(_documents(spark, folder), ["digest"], ["doc_id"]).drop("digest")


@query("""SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return keep_first(_documents(spark, folder), ["digest"], ["doc_id"]).drop("digest")


@query("""SELECT count(*) AS rows_read, count(*) FILTER (text IS NULL OR trim(text, ' ') = '') AS rows_skipped,
  count(DISTINCT text) FILTER (trim(text, ' ') <> '') AS rows_after_dedupe,
  count(*) FILTER (trim(text, ' ') <> '') - count(DISTINCT text) FILTER (trim(text, ' ') <> '') AS rows_collapsed
  FROM documents""")
def dedupe_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = base.read_table(spark, folder, "documents", ["text"]).select(
        F.sha2("text", 256).alias("digest"), F.when(F.trim("text") != "", "text").alias("filled")
    )
    return dedupe_stats(docs, ["digest"], required=["filled"])


@query("""SELECT l.doc_id AS label_doc, k.keeper AS doc_id, quality FROM labels l
  JOIN (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keeper FROM documents) k ON k.doc_id = l.doc_id""")
def keep_latest_repoint(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of dropped copies point at the copy that is kept."""
    docs = _documents(spark, folder).select("doc_id", "digest")
    labels = base.read_table(spark, folder, "labels").select(
        F.col("doc_id").alias("label_doc"), "doc_id", "quality"
    )
    _, (moved,) = keep_latest_and_repoint(docs, ["digest"], ["doc_id"], "doc_id", [(labels, "doc_id")])
    return moved


@query("""SELECT id, participant_id, CAST(delta AS DOUBLE) AS delta FROM ledger
  WHERE created_at >= TIMESTAMP '2024-01-16' AND idempotency_key NOT IN
    (SELECT idempotency_key FROM ledger WHERE created_at < TIMESTAMP '2024-01-16' )
  QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY id) = 1""", "ledger")
def append_once(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.ledger(spark, folder)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    out = append_idempotent(
        rows.where(F.col("created_at") < cut), rows.where(F.col("created_at") >= cut), "idempotency_key", ["id"]
    )
    return out.select("id", "participant_id", F.col("delta").cast("double").alias("delta"))


# Grants are ledger rows given to the customer of the same number, for the round of their day; every tenth row is
# the ledger's history.  A key is a customer and a kind of event, so it is used again and again.
_GRANTS = """, rows AS (SELECT id AS row_no, participant_id, delta, participant_id || '-' || challenge_id AS idempotency_key,
    challenge_id AS reason, CASE WHEN challenge_id = 'error' THEN NULL WHEN challenge_id = 'view' THEN 99
      ELSE CAST(1 + participant_id % 7 AS INTEGER) END AS round_id,
    CASE WHEN challenge_id = 'error' THEN CAST(1 + participant_id % 3 AS INTEGER) END AS event_id,
    id % 3 = 0 AS force FROM ledger),
  used AS (SELECT DISTINCT idempotency_key FROM rows WHERE row_no % 10 = 0),
  judged AS (SELECT g.*, CASE WHEN g.round_id IS NOT NULL THEN r.event_id ELSE p.id END AS scope,
      coalesce(g.reason, '') = '' OR participant_id IS NULL OR delta IS NULL AS incomplete,
      g.idempotency_key IN (SELECT idempotency_key FROM used) AS known,
      CASE WHEN g.round_id IS NULL AND g.event_id IS NULL THEN 'no_target'
        WHEN g.round_id IS NOT NULL AND r.id IS NULL THEN 'unknown_round'
        WHEN g.round_id IS NULL AND p.id IS NULL THEN 'unknown_programme'
        WHEN g.round_id IS NULL AND p.kind <> 'virtual' THEN 'not_virtual'
        WHEN g.round_id IS NOT NULL AND NOT force AND NOT EXISTS (SELECT 1 FROM regs m, programmes e
            WHERE e.id = r.event_id AND e.kind = 'virtual' AND m.event_id = r.event_id
              AND m.email_normalized = c.email_normalized AND m.form_timestamp <= r.closes_at)
          THEN 'participant ineligible for challenge' END AS own
    FROM rows g LEFT JOIN rounds r ON r.id = g.round_id LEFT JOIN programmes p ON p.id = g.event_id
      LEFT JOIN regs c ON c.id = g.participant_id WHERE g.row_no % 10 <> 0),
  final AS (SELECT *, CASE WHEN incomplete THEN 'incomplete' WHEN known THEN 'duplicate'
      WHEN row_no > min(row_no) FILTER (own IS NULL AND NOT incomplete AND NOT known) OVER (PARTITION BY idempotency_key)
        THEN 'duplicate' ELSE own END AS outcome FROM judged)"""


def _granted(spark: SparkSession, folder: str):
    kind, pid = F.col("challenge_id"), F.col("participant_id")
    rows = base.ledger(spark, folder).select(
        F.col("id").alias("row_no"), "participant_id", "delta",
        F.concat_ws("-", pid.cast("string"), kind).alias("idempotency_key"), kind.alias("reason"),
        F.when(kind == "error", None).when(kind == "view", 99).otherwise((1 + pid % 7).cast("int")).alias("challenge_id"),
        F.when(kind == "error", (1 + pid % 3).cast("int")).alias("event_id"),
        (F.col("id") % 3 == 0).alias("force"),
    )
    people = base.registrations(spark, folder).select("id", "email")
    balances = base.enrolled(spark, folder).select(
        "participant_id", F.lit(2).alias("event_id"), F.lit(10).cast("decimal(24,4)").alias("balance")
    )
    return grant_credits(
        rows.where("row_no % 10 <> 0"), rows.where("row_no % 10 = 0"), balances, base.rounds(spark, folder),
        base.programmes(spark, folder), people, base.registrations(spark, folder),
    )


@query(_GRANTS + """ SELECT participant_id, event_id, CAST(sum(amount) AS DOUBLE) AS balance FROM (
    SELECT participant_id, 2 AS event_id, CAST(10 AS DECIMAL(14,4)) AS amount FROM enrolled
    UNION ALL SELECT participant_id, scope, delta FROM final WHERE outcome IS NULL) GROUP BY 1, 2""",
       "ledger", "rounds", "regs", "programmes", "enrolled")
def grant_credits_balances(spark: SparkSession, folder: str) -> DataFrame:
    out = _granted(spark, folder).balances.drop("_action")
    return out.withColumn("balance", F.col("balance").cast("double"))


@query(_GRANTS + " SELECT outcome, count(*) AS n FROM final WHERE outcome IS NOT NULL GROUP BY 1",
       "ledger", "rounds", "regs", "programmes")
def grant_credits_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rejects = _granted(spark, folder).rejects
    return rejects.groupBy(F.col("reason_rejected").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# --- references ---------------------------------------------------------------------------------


@query("""SELECT email_normalized, id, CASE WHEN session_on = DATE '1997-01-01' AND lower(trim(session_label, ' ')) = 'evening'
    THEN 0 WHEN session_on IS NULL AND trim(session_label, ' ') = '' THEN 1 ELSE 2 END AS match_rank FROM regs
  QUALIFY row_number() OVER (PARTITION BY email_normalized ORDER BY match_rank, id) = 1""", "regs")
def best_match_registration(spark: SparkSession, folder: str) -> DataFrame:
    return best_match(
        base.registrations(spark, folder), "email_normalized", "id", "session_on", "session_label",
        F.lit("1997-01-01").cast("date"), F.lit("Evening "),
    )


@query("""SELECT DISTINCT leader_email_normalized FROM subs WHERE leader_email_normalized NOT IN
  (SELECT email_normalized FROM regs WHERE form_timestamp >= TIMESTAMP '1997-01-01')""", "subs", "regs")
def missing_reference(spark: SparkSession, folder: str) -> DataFrame:
    regs = base.registrations(spark, folder).where(
        F.col("form_timestamp") >= F.lit("1997-01-01").cast("timestamp_ntz")
    )
    return missing_references(
        base.submissions(spark, folder), regs, "leader_email_normalized", "email_normalized"
    )


@query("""SELECT leader_email_normalized AS email_normalized, 'auto' AS utm_campaign,
    first(leader_name ORDER BY id) AS full_name FROM subs WHERE leader_email_normalized NOT IN
  (SELECT email_normalized FROM regs WHERE form_timestamp >= TIMESTAMP '1997-01-01') GROUP BY 1""", "subs", "regs")
def created_references(spark: SparkSession, folder: str) -> DataFrame:
    """Minimal registrations for leaders that have none."""
    regs = base.registrations(spark, folder).where(
        F.col("form_timestamp") >= F.lit("1997-01-01").cast("timestamp_ntz")
    ).select("email_normalized", F.lit("form").alias("utm_campaign"), "full_name")
    _, _, created = resolve_required(
        base.submissions(spark, folder), regs, "leader_email_normalized", "email_normalized", "create",
        {"full_name": "leader_name"}, ["id"], {"utm_campaign": F.lit("auto")},
    )
    return created


@query("""SELECT id, 'kept' AS outcome FROM subs WHERE leader_email_normalized IN (SELECT email_normalized FROM regs WHERE form_timestamp >= TIMESTAMP '1997-01-01')
  UNION ALL SELECT count(*), 'missing references' FROM (SELECT DISTINCT leader_email_normalized FROM subs WHERE leader_email_normalized NOT IN
    (SELECT email_normalized FROM regs WHERE form_timestamp >= TIMESTAMP '1997-01-01'))
  UNION ALL SELECT count(*), 'refused whole' FROM subs""", "subs", "regs")
def skipped_references(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions whose leader has a registration, and the number of leaders without; the strict policy refuses all of them."""
    regs = base.registrations(spark, folder).where(F.col("form_timestamp") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("email_normalized")
    subs = base.submissions(spark, folder).select(F.col("id").cast("long").alias("id"), "leader_email_normalized")
    kept, missing, _ = resolve_required(subs, regs, "leader_email_normalized", "email_normalized", "skip")
    try:
        resolve_required(subs, regs, "leader_email_normalized", "email_normalized", "error")
        refused = subs.limit(0)
    except ValueError:
        refused = subs
    total = lambda df, outcome: df.agg(F.count(F.lit(1)).alias("id")).withColumn("outcome", F.lit(outcome))
    return kept.select("id", F.lit("kept").alias("outcome")).unionByName(total(missing, "missing references")).unionByName(total(refused, "refused whole"))


@query("""SELECT i.id, s.id AS session_id FROM ip_subs i LEFT JOIN sessions s
  ON lower(trim(i.attendance_city, ' ')) = lower(trim(s.city, ' ')) AND i.session_on = s.session_on
  AND lower(trim(i.session_label, ' ')) = lower(trim(s.session_label, ' '))""", "sessions")
def relink_by_key(spark: SparkSession, folder: str) -> DataFrame:
    facts = base.in_person_submissions(spark, folder).select(
        "id", "attendance_city", "session_on", "session_label", F.lit(None).cast("long").alias("session_id")
    )
    dim = base.sessions(spark, folder).select(
        F.col("id").alias("sid"), "city", F.col("session_on").alias("on"), F.col("session_label").alias("label")
    )
    on = {"attendance_city": "city", "session_on": "on", "session_label": "label"}
    linked = relink_by_natural_key(facts, dim, on, "session_id", "sid", lower=["attendance_city", "session_label"])
    return linked.select("id", "session_id")


def _deleted(spark: SparkSession, folder: str):
    nation = base.read_table(spark, folder, "nation")
    customer = base.read_table(spark, folder, "customer", ["c_custkey", "c_nationkey"])
    supplier = base.read_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    return unlink_then_delete(
        nation, "n_nationkey", F.col("n_regionkey") == 2,
        {"customer": (customer, "c_nationkey"), "supplier": (supplier, "s_nationkey")},
    )


@query("""SELECT c_custkey, CASE WHEN n_regionkey <> 2 THEN c_nationkey END AS c_nationkey
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def unlink_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _deleted(spark, folder)[1]["customer"]


@query("""SELECT 'customer' AS fact, count(*) AS n_unlinked FROM customer JOIN nation ON n_nationkey = c_nationkey
  WHERE n_regionkey = 2 UNION ALL SELECT 'supplier', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey
  WHERE n_regionkey = 2""")
def unlink_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _deleted(spark, folder)[2]


@query(""", b AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000000000 ELSE o_custkey END
    AS scope, CASE WHEN o_orderpriority = '5-LOW' THEN 'NATION_0' ELSE n_name END AS city
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r.id IS NULL THEN 'scope not found'
    WHEN b.city <> r.city THEN 'city does not match scope' ELSE 'accepted' END AS reason
    FROM b LEFT JOIN regs r ON r.id = b.scope) GROUP BY 1""", "regs")
def scope_gate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    scopes = base.registrations(spark, folder).select(F.col("id").alias("scope"), "city")
    own = scopes.select(F.col("scope").alias("_own"), F.col("city").alias("_city"))
    batch = base.read_table(spark, folder, "orders").join(own, F.col("o_custkey") == F.col("_own")).select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey"))
        .alias("scope"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NATION_0").otherwise(F.col("_city")).alias("city"),
    )
    ok, rejects = scope_gate(batch, scopes, "scope", {"city": "city"})
    outcome = ok.select(F.lit("accepted").alias("reason")).unionByName(rejects.select("reason"))
    return outcome.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- change capture -------------------------------------------------------------------------------


@query(_VERSIONS + """, j AS (SELECT coalesce(c.id, i.id) AS id, c.id IS NULL AS ins, i.id IS NULL AS del,
    c.name IS DISTINCT FROM i.name AS d1, c.segment IS DISTINCT FROM i.segment AS d2,
    c.balance IS DISTINCT FROM i.balance AS d3, c.segment AS old_segment, i.segment AS new_segment
    FROM cur c FULL JOIN inc i ON c.id = i.id)
  SELECT CASE WHEN ins THEN 'INSERT' WHEN del THEN 'DELETE' ELSE 'UPDATE' END AS op, '{"id":' || id || '}' AS record_pk,
    CASE WHEN NOT ins AND NOT del THEN concat_ws(',', CASE WHEN d1 THEN 'name' END, CASE WHEN d2 THEN 'segment' END,
      CASE WHEN d3 THEN 'balance' END) END AS changed,
    CASE WHEN NOT ins AND NOT del AND d2 THEN old_segment || '>' || new_segment END AS segment_change
  FROM j WHERE ins OR del OR d1 OR d2 OR d3""")
def change_diff(spark: SparkSession, folder: str) -> DataFrame:
    changes = diff_changes(_current(spark, folder), _incoming(spark, folder), ["id"])
    segment = F.col("changes")["segment"]
    return changes.select(
        "op", "record_pk", F.array_join("changed_columns", ",").alias("changed"),
        F.concat(segment["old"], F.lit(">"), segment["new"]).alias("segment_change"),
    )


