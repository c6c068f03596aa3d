"""Several loads, several runs, deep pages and other session zones lose nothing."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidelog import sources as src
from tidelog.functions.timeexpr import TimeRange
from tidelog.operators.compare import period_counts, period_stats
from tidelog.operators.ordering import first_matches, page_after, encode_cursor, tail
from tidelog.operators.predicates import in_time_range
from tidelog.session import shared_dir
from tidelog.streaming.run import run_to_table


def load(lines, first, n):
    values = [{"timestamp": f"2024-01-05T00:{i:02}:00Z", "message": f"m{i}"} for i in range(first, first + n)]
    return src.parse_lines(lines(values))


def test_appended_loads_keep_their_order(spark, lines):
    path = shared_dir(spark, "logs")
    for mode, first in (("overwrite", 0), ("append", 5), ("append", 10)):
        src.write_log_table(load(lines, first, 5), path, mode)
    table = src.read_log_table(spark, path)
    assert [r.seq for r in table.orderBy("seq").collect()] == list(range(15))
    assert [r.message for r in tail(table, 4).collect()] == ["m11", "m12", "m13", "m14"]
    seen, cursor = [], None
    while rows := page_after(table, cursor, 4).collect():
        seen += [r.message for r in rows]
        cursor = encode_cursor(rows[-1].ts.astimezone(timezone.utc), rows[-1].seq, rows[-1].source)
    assert seen == [f"m{i}" for i in range(14, -1, -1)]


def test_pages_at_any_depth(made):
    logs = made(*[{"message": f"m{i}", "source": "a"} for i in range(300)])
    logs = logs.withColumn("seq", F.when(F.col("seq") % 3 > 0, F.col("seq") * 1000))
    pages = [first_matches(logs, 70, at).collect() for at in range(0, 350, 70)]
    assert [len(p) for p in pages] == [70, 70, 70, 70, 20]
    rows = [r for p in pages for r in p]
    assert len({r.message for r in rows}) == 300
    known = [r.seq for r in rows if r.seq is not None]
    assert known == sorted(known) and all(r.seq is None for r in rows[:100])


def test_days_are_utc_in_any_session(spark, lines):
    path = shared_dir(spark, "logs")
    src.write_log_table(load(lines, 0, 5), path)
    early = datetime(2024, 1, 5, tzinfo=timezone.utc)
    tr = TimeRange(early, early.replace(hour=2))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert in_time_range(src.read_log_table(spark, path), tr).count() == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_comparisons_prune_days(spark, lines):
    path = shared_dir(spark, "logs")
    src.write_log_table(load(lines, 0, 5), path)
    table = src.read_log_table(spark, path)
    day = datetime(2024, 1, 5, tzinfo=timezone.utc)
    tr = TimeRange(day, day.replace(hour=2))
    for df in (period_counts(table, tr, tr), period_stats(table, tr)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [((isnull(dt" in plan or "PartitionFilters: [(isnull(dt" in plan


def test_a_stream_goes_on_where_it_ended(spark):
    given, path = shared_dir(spark, "input"), shared_dir(spark, "output")
    for n, total in ((100, 100), (150, 250), (50, 300)):
        spark.range(n).write.mode("append").parquet(given)
        assert run_to_table(spark.readStream.schema("id bigint").parquet(given), path).count() == total
