"""Time the scale form of an operator against the direct form on a written log table.

python tools/compare_forms.py [sf_dir] [copies]: the events of sf_dir, repeated under later times
until the table is large enough to show a difference.
"""

from __future__ import annotations

import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window as W, functions as F  # noqa: E402

from tests.oracle import local_session  # noqa: E402
from tidelog import TimeRange  # noqa: E402
from tidelog.operators import aggregate, compare, correlate, detect, predicates  # noqa: E402
from tidelog.plans.events import as_logs, table  # noqa: E402
from tidelog.sources import read_log_table, write_log_table  # noqa: E402


def build(spark, sf_dir, copies):
    events = table(spark, sf_dir, "events")
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    shifted = events.select("*", copy).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") + F.col("copy") * 17_000_003)
    )
    shifted = shifted.withColumn("event_id", F.col("event_id") * copies + F.col("copy")).drop("copy")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/logs"
    write_log_table(as_logs(shifted), path)
    return read_log_table(spark, path)


def any_field(logs, text):
    columns = ["message", "service", "host"]
    hit = F.exists(F.map_values("fields"), lambda v: F.lower(v).contains(text))
    for name in columns:
        hit = hit | F.lower(name).contains(text)
    return logs.where(hit)


def direct_islands(logs, seconds):
    """One window over all rows: the form that cannot be split."""
    whole = W.orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(whole))
    step = F.coalesce(gap > seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = logs.select("ts", "level", step.alias("step")).withColumn("g", F.sum("step").over(whole))
    return numbered.groupBy("g").agg(F.min("ts"), F.max("ts"), F.count("*"))


def session_islands(logs):
    return logs.groupBy(F.session_window("ts", "5 minutes")).agg(F.count("*"))


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = local_session()
    logs = build(spark, sf_dir, int(argv[1]) if len(argv) > 1 else 1)
    errors = predicates.filter_logs(logs, "ERROR")
    early = TimeRange.of("2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z")
    late = TimeRange.of("2024-01-12T00:00:00Z", "2024-01-19T00:00:00Z")
    forms = {
        "scan + count": lambda: logs.agg(F.count("*"), F.max("ts")),
        "errors per service per hour": lambda: aggregate.aggregate(errors, ["service"], bucket="1h"),
        "search over search_text": lambda: predicates.search(logs, "timeout").agg(F.count("*")),
        "search, five-way or": lambda: any_field(logs, "timeout").agg(F.count("*")),
        "near in time, cells, 5m": lambda: correlate.correlate_time(errors, "5m"),
        "near in time, lag, 5m": lambda: direct_islands(errors, 300),
        "near in time, session_window, 5m": lambda: session_islands(errors),
        "near in time, cells, 1s": lambda: correlate.correlate_time(errors, "1s"),
        "near in time, lag, 1s": lambda: direct_islands(errors, 1),
        "error templates": lambda: detect.detect_error_patterns(logs),
        "volume anomalies": lambda: detect.find_anomalies(logs),
        "period comparison": lambda: compare.compare_periods(logs, early, late),
    }
    print("rows", logs.count())
    for name, form in forms.items():
        times = []
        for _ in range(4):
            begin = time.perf_counter()
            form().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        print(f"{name:36s} {statistics.median(times[1:]):.2f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
