"""Headline queries, warm, median of three: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.plans import catalog  # noqa: E402
from tidelog.session import configure  # noqa: E402

HEADLINE = (
    "a2_parse_json_lines", "a3_parse_regex_lines", "a8_normalize_loki",
    "b1_search", "b2_filter_logs", "b3_in_time_range",
    "c1_latest", "c2_first_matches", "c4_tail", "c6_top_per_source", "c7_timeline",
    "d1_d4_errors_per_service_hour", "d2_avg", "d6_over_time", "d7_stats_by", "d8_facet_counts", "d10_summarize",
    "e1_trace_groups", "e2_correlate_time", "e2_correlated_entries", "e4_correlate",
    "f7_rank_causes", "f8_root_cause", "g5_compare_periods",
    "h1_detect_error_patterns", "h2_anomalies_volume", "i_tag_questions", "s2_follow_aggregate",
)
RUNS = 3


def timed(run) -> float:
    begin = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidelog-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    found = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        query = lambda: found[name](spark, sf_dir)
        timed(query)
        seconds[name] = round(statistics.median(timed(query) for _ in range(RUNS)), 4)
    print(
        json.dumps(
            {
                "metric": "log_analytics_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
