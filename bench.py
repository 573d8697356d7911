"""Time the headline queries and print one JSON line.

Each query is run once unmeasured (class loading, code generation, file listing) and then
measured; the result is consumed in full by a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from turnout.catalog import QUERIES
from turnout.session import build_session

HEADLINE = (
    "round_leaderboard_page",
    "session_leaderboard_top",
    "global_leaderboard_top",
    "global_rank_full",
    "ledger_leaderboard",
    "score_histogram",
    "score_stats_by_segment",
    "score_stats_distributed",
    "attempt_buckets_by_round",
    "conversion_funnel_by_day",
    "registration_totals_all",
    "daily_timeline",
    "facet_value_lists",
    "eligible_counts",
    "registrations_by_moment",
    "roster_page_by_score",
    "participation_union",
    "round_summary_report",
    "track_overlap",
    "cohort_vs_prior_round",
    "cohort_vs_prior_session",
    "retention_of_top_250",
    "crossover_city_breakdown",
    "rsvp_overlay_counts",
    "upsert_keep_if_null",
    "patch_attempts",
    "dedupe_keep_last",
    "grant_credits_balances",
    "change_diff",
    "activity_search_page",
    "json_records",
    "csv_registrations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(
        "turnout-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in wanted:
        for measured in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if measured:
                times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
