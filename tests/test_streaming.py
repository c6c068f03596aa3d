import pytest
from pyspark.sql import functions as F

from tidelog.functions.timestamps import iso_text
from tidelog.operators import correlate, detect
from tidelog.plans.events import as_logs, logs
from tidelog.schema import LOG_SCHEMA
from tidelog.streaming import follow as live
from tidelog.streaming.run import run_to_table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Logs as four files written in time order, read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("stream") / "logs")
    for part in range(4):
        week = logs(spark, SF_DIR).where((F.dayofmonth("ts") - 1).between(part * 8, part * 8 + 7))
        week.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def complete(df):
    """All results so far, also of windows that are still open; a test may hold them in memory."""
    writer = df.writeStream.outputMode("complete").format("memory").queryName("live")
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table("live")


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_follow(spark, table):
    got = run_to_table(live.follow(stream(spark, table), "timeout", service="svc2"))
    want = logs(spark, SF_DIR).where("contains(message, 'timeout') and service = 'svc2'")
    assert rows(got.select("seq", "message")) == rows(want.select("seq", "message"))


def batch_counts(spark):
    start = F.window("ts", "1 hour").start.alias("timestamp_bucket")
    return logs(spark, SF_DIR).groupBy(start, "level").agg(F.count("*").alias("count"))


def test_windows_complete(spark, table):
    got = complete(live.follow_aggregate(stream(spark, table), ["level"], "1h"))
    assert rows(got.select("timestamp_bucket", "level", "count")) == rows(batch_counts(spark).select("timestamp_bucket", "level", "count"))


def test_windows_append_leaves_open_ones_out(spark, table):
    got = run_to_table(live.follow_aggregate(stream(spark, table), ["level"], "1h", "10m"))
    newest = logs(spark, SF_DIR).agg(F.max("ts")).first()[0]
    closed = batch_counts(spark).where(F.col("timestamp_bucket") + F.expr("interval 70 minutes") <= F.lit(newest))
    assert rows(got.select("timestamp_bucket", "level", "count")) == rows(closed)
    assert 0 < closed.count() < batch_counts(spark).count()


def test_sessions_equal_batch_chains(spark, table):
    got = complete(live.follow_correlate(stream(spark, table), "40m", "service", "1h"))
    for service in ("svc0", "svc3"):
        want = correlate.correlate_time(logs(spark, SF_DIR), "40m", service)
        names = ["start_ts", "end_ts", "entries", "score"]
        assert rows(got.where(F.col("service") == service).select(names)) == rows(want.select(names))


def test_scores_against_batch_model(spark, table):
    model = detect.anomaly_model(logs(spark, SF_DIR), bucket="6h", by=["source"])
    found = live.follow_anomalies(stream(spark, table), model, ["source"], "6h", "10m", "high")
    got = rows(run_to_table(found).select(iso_text(F.col("timestamp_bucket")), "source", "actual_value"))
    batch = detect.find_anomalies(logs(spark, SF_DIR), by=["source"], bucket="6h", sensitivity="high")
    want = rows(batch.where("actual_value > 0").select(iso_text(F.col("timestamp_bucket")), "source", "actual_value"))
    last = max(r[0] for r in rows(batch_counts(spark).select(iso_text(F.col("timestamp_bucket")))))[:10]
    assert got and set(got) <= set(want) and all(r[0] >= last for r in set(want) - set(got))
    with pytest.raises(ValueError):
        live.follow_anomalies(stream(spark, table), model, by=())


def test_events_stream_is_the_same_view(spark):
    from tidelog.plans.events import event_stream

    assert as_logs(event_stream(spark, SF_DIR)).schema == logs(spark, SF_DIR).schema
