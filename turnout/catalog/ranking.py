"""Leaderboards, ranks and distributions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.catalog import base
from turnout.catalog.base import day_text, query
from turnout.operators.distribution import attempt_buckets, histogram, score_rollup, score_stats, with_segment
from turnout.operators.ordering import deep_page, global_rank
from turnout.operators.sessions import default_session, session_options
from turnout.plans.leaderboards import (
    balance_scores,
    conversion_funnel,
    global_leaderboard,
    leader_averages,
    ledger_scores,
    missing_in_action,
    ranked_scores,
    round_leaderboard,
    score_order,
    session_leaderboard,
)
from turnout.operators.resolve import kind_gate
from turnout.plans.stats import round_stats, segment_counts, session_stats, submission_totals

_BOARD = """SELECT {rank} AS rank, team_name, leader_name, leader_email, CAST(total_score AS DOUBLE) AS total_score{more},
  strftime(export_created_at, '%Y-%m-%d') AS submitted_at FROM {rows}"""
_ROW_NUMBER = "row_number() OVER (ORDER BY total_score DESC NULLS LAST, export_created_at ASC NULLS LAST, id ASC)"


def _board(df: DataFrame) -> DataFrame:
    return df.withColumn("total_score", F.col("total_score").cast("double")).withColumn(
        "submitted_at", F.date_format("submitted_at", "yyyy-MM-dd")
    )


@query("SELECT * FROM (" + _BOARD.format(rank=_ROW_NUMBER, more="", rows="subs WHERE challenge_id = 3")
       + ") WHERE rank BETWEEN 21 AND 70", "subs")
def round_leaderboard_page(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.submissions(spark, folder)
    return _board(round_leaderboard(subs.where("challenge_id = 3"), limit=50, offset=20))


@query("SELECT * FROM (" + _BOARD.format(
    rank=_ROW_NUMBER, more=", attendance_city", rows="ip_subs WHERE sheet_kind = 'main'") + ") WHERE rank <= 50",
    "ip_subs")
def session_leaderboard_top(spark: SparkSession, folder: str) -> DataFrame:
    return _board(session_leaderboard(base.in_person_submissions(spark, folder)))


_AVERAGES = """averages AS (
  SELECT leader_email_normalized, CAST(sum(coalesce(total_score, 0)) AS DOUBLE) / count(*) AS average_score,
    min(export_created_at) AS submitted_at, count(DISTINCT challenge_id) AS arena_count,
    first(team_name ORDER BY total_score DESC NULLS LAST, export_created_at ASC NULLS LAST, id ASC) AS team_name,
    first(leader_name ORDER BY total_score DESC NULLS LAST, export_created_at ASC NULLS LAST, id ASC) AS leader_name
  FROM subs GROUP BY 1)"""


@query(", " + _AVERAGES + """ SELECT * FROM (SELECT row_number() OVER (ORDER BY average_score DESC,
  submitted_at ASC, leader_email_normalized ASC) AS rank, leader_email_normalized, team_name, leader_name,
  round(average_score, 6) AS average_score, strftime(submitted_at, '%Y-%m-%d') AS submitted_at, arena_count
  FROM averages) WHERE rank <= 100""", "subs")
def global_leaderboard_top(spark: SparkSession, folder: str) -> DataFrame:
    top = global_leaderboard(base.submissions(spark, folder), limit=100)
    return top.select(
        "rank", "leader_email_normalized", "team_name", "leader_name",
        F.round("average_score", 6).alias("average_score"), day_text("submitted_at"), "arena_count",
    )


@query(", " + _AVERAGES + """ SELECT row_number() OVER (ORDER BY average_score DESC, submitted_at ASC,
  leader_email_normalized ASC) AS place, leader_email_normalized, arena_count FROM averages""", "subs")
def global_rank_of_leaders(spark: SparkSession, folder: str) -> DataFrame:
    averages = leader_averages(base.submissions(spark, folder)).select(
        "leader_email_normalized", "average_score", "submitted_at", "arena_count"
    )
    order = score_order("average_score", "submitted_at", "leader_email_normalized")
    return global_rank(averages, order, name="place").select("place", "leader_email_normalized", "arena_count")


@query("""SELECT id, rank() OVER (ORDER BY attempts_completed DESC NULLS LAST) AS tie_rank,
  row_number() OVER (ORDER BY attempts_completed DESC NULLS LAST, id) AS place FROM subs""", "subs")
def global_rank_full(spark: SparkSession, folder: str) -> DataFrame:
    """Every submission ranked by a column with few values, so ties run over many partitions."""
    rows = base.submissions(spark, folder).select("id", "attempts_completed")
    order = [F.col("attempts_completed").desc_nulls_last(), F.col("id").asc()]
    ranked = global_rank(rows, order, ties=["attempts_completed"], name="tie_rank", row_name="place")
    return ranked.select("id", "tie_rank", "place")


@query("""SELECT id, tie_rank FROM (SELECT id, rank() OVER w AS tie_rank, row_number() OVER (ORDER BY attempts_completed DESC NULLS LAST, id) AS place
    FROM subs WINDOW w AS (ORDER BY attempts_completed DESC NULLS LAST)) WHERE place BETWEEN (SELECT count(*) // 2 FROM subs) + 1 AND (SELECT count(*) // 2 FROM subs) + 500""", "subs")
def page_in_the_middle(spark: SparkSession, folder: str) -> DataFrame:
    """The page of 500 that starts half way down all submissions, with the ranks that ties share."""
    rows = base.submissions(spark, folder).select("id", "attempts_completed")
    order = [F.col("attempts_completed").desc_nulls_last(), F.col("id").asc()]
    return deep_page(rows, order, 500, rows.count() // 2, ties=["attempts_completed"], name="tie_rank").select("id", "tie_rank")


_LEDGER_SCORES = """scores AS (SELECT e.participant_id, coalesce(sum(delta), 0) AS score
  FROM enrolled e LEFT JOIN ledger l ON l.participant_id = e.participant_id{extra} GROUP BY 1)"""
_SCORE_PAGE = """ SELECT participant_id, CAST(score AS DOUBLE) AS score, rank FROM (
  SELECT *, rank() OVER (ORDER BY score DESC) AS rank, row_number() OVER (ORDER BY score DESC, participant_id) AS rn
  FROM scores) WHERE rn <= {n}"""


@query(", " + _LEDGER_SCORES.format(extra=" AND l.challenge_id = 'purchase'") + _SCORE_PAGE.format(n=200),
       "enrolled", "ledger")
def ledger_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    scores = ledger_scores(base.enrolled(spark, folder), base.ledger(spark, folder), "purchase")
    return ranked_scores(scores, 200).withColumn("score", F.col("score").cast("double"))


@query(", " + _LEDGER_SCORES.format(extra="") + _SCORE_PAGE.format(n=100), "enrolled", "ledger")
def balance_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    balances = base.ledger(spark, folder).groupBy("participant_id").agg(
        F.sum("delta").alias("balance")
    )
    scores = balance_scores(base.enrolled(spark, folder), balances)
    return ranked_scores(scores, 100).withColumn("score", F.col("score").cast("double"))


@query(""", v AS (SELECT CAST(total_score AS DOUBLE) AS v FROM subs WHERE total_score IS NOT NULL),
  s AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 12.0 AS w FROM v),
  c AS (SELECT least(CAST(floor((v - lo) / w) AS INTEGER), 11) AS bin, count(*) AS n FROM v, s GROUP BY 1)
  SELECT b.bin, round(lo + b.bin * w, 4) AS low,
    round(CASE WHEN b.bin = 11 THEN hi ELSE lo + (b.bin + 1) * w END, 4) AS high, coalesce(n, 0) AS count
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(12)) b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin""", "subs")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = histogram(base.submissions(spark, folder), "total_score", 12)
    return bins.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "count")


@query("""SELECT challenge_id, count(*) AS row_n, count(total_score) AS scored_n,
  CAST(min(total_score) AS DOUBLE) AS min_score, CAST(max(total_score) AS DOUBLE) AS max_score,
  round(CAST(sum(total_score) AS DOUBLE) / count(total_score), 5) AS avg_score,
  round(stddev_pop(CAST(total_score AS DOUBLE)), 4) AS stddev_score FROM subs GROUP BY 1""", "subs")
def score_rollup_by_round(spark: SparkSession, folder: str) -> DataFrame:
    out = score_rollup(base.submissions(spark, folder), "total_score", by=["challenge_id"])
    return out.withColumns({"avg_score": F.round("avg_score", 5), "stddev_score": F.round("stddev_score", 4)})


_SEGMENT = """CASE WHEN s.registration_id IS NULL THEN 'unknown'
    WHEN lower(trim(r.occupation, ' ')) IN ('college_student', 'student') THEN 'student'
    WHEN lower(trim(r.occupation, ' ')) IN ('professional', 'startup', 'freelance', 'freelancer') THEN 'professional'
    ELSE 'other' END"""
_SEGMENTED = f", seg AS (SELECT s.*, {_SEGMENT} AS segment FROM subs s LEFT JOIN regs r ON r.id = s.registration_id)"
_STATS = """count(total_score) AS n_scored, CAST(min(total_score) AS DOUBLE) AS min_score,
  CAST(max(total_score) AS DOUBLE) AS max_score,
  round(CAST(sum(total_score) AS DOUBLE) / count(total_score), 5) AS avg_score,
  round(stddev_samp(CAST(total_score AS DOUBLE)), 4) AS stddev_score,
  round(quantile_cont(CAST(total_score AS DOUBLE), 0.25), 5) AS p25,
  round(quantile_cont(CAST(total_score AS DOUBLE), 0.5), 5) AS median,
  round(quantile_cont(CAST(total_score AS DOUBLE), 0.75), 5) AS p75,
  round(CAST(max(total_score) AS DOUBLE) - CAST(min(total_score) AS DOUBLE), 4) AS score_range"""


def _rounded(df: DataFrame) -> DataFrame:
    places = {"avg_score": 5, "stddev_score": 4, "p25": 5, "median": 5, "p75": 5, "score_range": 4}
    return df.withColumns({c: F.round(c, d) for c, d in places.items()})


def _segmented(spark: SparkSession, folder: str) -> DataFrame:
    regs = base.registrations(spark, folder)
    return with_segment(base.submissions(spark, folder), regs, "registration_id", "id", "occupation")


@query(_SEGMENTED + f" SELECT segment, {_STATS} FROM seg GROUP BY 1", "subs", "regs")
def score_stats_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(score_stats(_segmented(spark, folder), "total_score", by=["segment"]))


@query(f"SELECT challenge_id, {_STATS} FROM subs GROUP BY 1", "subs")
def score_stats_distributed(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(score_stats(base.submissions(spark, folder), "total_score", by=["challenge_id"]))


@query(_SEGMENTED + """ SELECT count(*) FILTER (segment = 'unknown') AS team_segment_unknown,
  count(*) FILTER (segment = 'student') AS team_segment_student,
  count(*) FILTER (segment = 'professional') AS team_segment_professional,
  count(*) FILTER (segment = 'other') AS team_segment_other FROM seg""", "subs", "regs")
def segment_counts_all(spark: SparkSession, folder: str) -> DataFrame:
    return segment_counts(_segmented(spark, folder))


@query(_SEGMENTED + """ SELECT challenge_id, segment,
  CASE WHEN attempts_completed IS NULL OR attempts_completed < 1 THEN 0 ELSE attempts_completed END AS bucket,
  count(*) AS n FROM seg WHERE segment IN ('student', 'professional') GROUP BY 1, 2, 3""", "subs", "regs")
def attempt_buckets_by_round(spark: SparkSession, folder: str) -> DataFrame:
    return attempt_buckets(_segmented(spark, folder), "attempts_completed", by=["challenge_id"])


@query("""SELECT count(*) AS total_submissions, count(DISTINCT registration_id) AS unique_registrations,
  count(registration_id) AS linked_submissions FROM subs""", "subs")
def submission_totals_all(spark: SparkSession, folder: str) -> DataFrame:
    return submission_totals(base.submissions(spark, folder))


def _funnel_facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = base.read_table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type"
    )
    return events.where("event_type = 'view'"), events.where("event_type = 'purchase'")


@query("""SELECT d.day, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS rsvp_count,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS submission_count,
  CASE WHEN count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) = 0 THEN 0.0 ELSE
    round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END)
      / count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END), 6) END AS conversion_rate
  FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events) d
  LEFT JOIN events e ON strftime(e.ts, '%Y-%m-%d') = d.day GROUP BY 1""")
def conversion_funnel_by_day(spark: SparkSession, folder: str) -> DataFrame:
    views, purchases = _funnel_facts(spark, folder)
    days = base.read_table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return conversion_funnel(days.withColumnRenamed("day", "day"), views, purchases, "day", "user_id")


@query("""SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events e WHERE event_type = 'view'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id
    AND strftime(p.ts, '%Y-%m-%d') = strftime(e.ts, '%Y-%m-%d'))""")
def missing_in_action_by_day(spark: SparkSession, folder: str) -> DataFrame:
    views, purchases = _funnel_facts(spark, folder)
    return missing_in_action(views, purchases, ["day", "user_id"])


# Sessions as labelled by the teams; postponed tracks play for another event.
_OPTIONS = """, played AS (SELECT * REPLACE (CASE WHEN track = 'P' THEN 3 ELSE 1 END AS event_id) FROM ip_subs),
  held AS (SELECT lower(trim(attendance_city, ' ')) AS city, session_on, session_label, min(id) AS id, 1 AS event_id
    FROM played GROUP BY 1, 2, 3),
  teams AS (SELECT event_id, lower(trim(attendance_city, ' ')) AS city, session_on, session_label, count(*) AS n
    FROM played WHERE sheet_kind = 'main' GROUP BY 1, 2, 3, 4),
  options AS (SELECT s.*, coalesce(n, 0) AS team_count, coalesce(n, 0) > 0 AS has_data FROM held s LEFT JOIN teams t
    ON t.event_id = s.event_id AND t.city = s.city AND t.session_on = s.session_on AND t.session_label = s.session_label)"""


def _options(spark: SparkSession, folder: str) -> DataFrame:
    subs = base.in_person_submissions(spark, folder).withColumn("event_id", F.when(F.col("track") == "P", 3).otherwise(1))
    held = subs.groupBy(F.lower(F.trim("attendance_city")).alias("city"), "session_on", "session_label").agg(
        F.min("id").alias("id")).withColumn("event_id", F.lit(1))
    return session_options(held, subs)


@query(_OPTIONS + """ SELECT id, city, strftime(session_on, '%Y-%m-%d') AS session_on, session_label, team_count, has_data
  FROM options""", "ip_subs")
def session_options_list(spark: SparkSession, folder: str) -> DataFrame:
    options = _options(spark, folder)
    return options.select("id", "city", day_text("session_on"), "session_label", "team_count", "has_data")


@query(_OPTIONS + """ SELECT id, city, strftime(session_on, '%Y-%m-%d') AS session_on, session_label, team_count
  FROM options WHERE session_on <= DATE '1999-11-15'
  ORDER BY options.session_on DESC, team_count DESC, id DESC LIMIT 1""", "ip_subs")
def default_session_pick(spark: SparkSession, folder: str) -> DataFrame:
    options = _options(spark, folder)
    pick = default_session(options, "session_on", date(1999, 11, 15), "id", "team_count")
    return pick.select("id", "city", day_text("session_on"), "session_label", "team_count")




_SESSION = """WHERE sheet_kind = 'main' AND lower(trim(attendance_city, ' ')) = 'nation_4'
  AND session_on = DATE '1997-04-01' AND lower(trim(session_label, ' ')) = ''"""


def _one_session(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return session_stats(
        base.in_person_submissions(spark, folder), base.registrations(spark, folder), base.sessions(spark, folder),
        " Nation_4", date(1997, 4, 1), "",
    )


@query(f"SELECT {_STATS} FROM ip_subs {_SESSION}", "ip_subs")
def session_score_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_one_session(spark, folder)["scores"])


@query("""SELECT count(*) AS registrations FROM regs WHERE lower(trim(coalesce(attendance_city, ''), ' ')) = 'nation_4'
  AND session_on = DATE '1997-04-01' AND lower(trim(session_label, ' ')) = ''""", "regs")
def session_registration_count(spark: SparkSession, folder: str) -> DataFrame:
    return _one_session(spark, folder)["registrations"]


@query(f"""SELECT count(*) AS total_submissions, count(DISTINCT registration_id) AS unique_registrations,
  count(registration_id) AS linked_submissions FROM ip_subs {_SESSION}""", "ip_subs")
def session_submission_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _one_session(spark, folder)["totals"]


@query(_SEGMENTED + f" SELECT segment, {_STATS} FROM seg WHERE challenge_id = 5 AND segment IN ('student', 'professional')"
       + " GROUP BY 1", "subs", "regs")
def round_segment_scores(spark: SparkSession, folder: str) -> DataFrame:
    found = round_stats(
        base.submissions(spark, folder), base.registrations(spark, folder), base.rounds(spark, folder), 5
    )
    return _rounded(found["segment_scores"])


@query("""SELECT count(*) AS row_n, round(stddev_pop(CAST(total_score AS DOUBLE)), 4) AS stddev_score FROM subs
  WHERE challenge_id IN (SELECT r_regionkey FROM region WHERE r_name >= 'ASIA')""", "subs")
def kind_gated_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of programmes of one kind; regions stand for programmes, those from A to AS for the other kind."""
    programmes = base.read_table(spark, folder, "region").select(
        F.col("r_regionkey").alias("id"), F.when(F.col("r_name") >= "ASIA", "virtual").otherwise("in_person").alias("kind")
    )
    rollup = score_rollup(kind_gate(base.submissions(spark, folder), programmes, "virtual", "challenge_id"), "total_score")
    return rollup.select("row_n", F.round("stddev_score", 4).alias("stddev_score"))
