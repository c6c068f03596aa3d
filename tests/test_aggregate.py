import pytest
from pyspark.sql import functions as F

from tests.conftest import at, utc
from tidelog import TimeRange
from tidelog.functions.timestamps import time_bucket
from tidelog.operators import aggregate as a
from tidelog.operators import summary

ROWS = [
    {"timestamp": "2026-05-24T10:00:00Z", "level": "INFO", "message": "a", "service": "payment", "duration_ms": 100},
    {"timestamp": "2026-05-24T10:07:30Z", "level": "INFO", "message": "b", "service": "payment", "duration_ms": "300"},
    {"timestamp": "2026-05-24T11:00:00Z", "level": "ERROR", "message": "a", "service": "api", "duration_ms": 200},
    {"timestamp": "?", "level": "ERROR", "message": "a", "duration_ms": "fast"},
]


@pytest.fixture
def logs(entries):
    return entries(ROWS).cache()


def table(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize(
    "metric, payment", [("avg", 200.0), ("average", 200.0), ("sum", 400.0), ("min", 100.0), ("max", 300.0), ("count", 2.0), ("p99", 2.0)]
)
def test_metrics(logs, metric, payment):
    got = table(a.aggregate(logs, ["service"], metric, "duration_ms"), "service", "value", "count")
    assert ("payment", payment, 2) in got
    if metric in ("avg", "sum", "min", "max"):
        assert ("unknown", 0.0, 1) in got


def test_numbers(entries):
    texts = ["1", " 2.5 ", "1e3", "-.5", "1d", "NaN", "Infinity", "1e999", "1_000", "", "x", "0x1F", "+7."]
    df = entries([{"message": "m", "v": t} for t in texts] + [{"message": "m", "v": True}])
    got = [r[0] for r in df.orderBy("seq").select(a.numeric_field("v")).collect()]
    assert got == [1.0, 2.5, 1000.0, -0.5] + [None] * 8 + [7.0, None]


def test_level_is_never_numeric(entries):
    df = entries([{"message": "m", "level": "3"}])
    assert a.aggregate(df, [], "sum", "level").first().value == 0.0
    assert a.aggregate(df, [], "sum").first().value == 0.0


def test_no_rows_no_bucket(logs):
    none = TimeRange.of("2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z")
    assert a.aggregate(logs.where("ts is not null"), tr=none).count() == 0


def test_key_rules(logs):
    got = table(a.aggregate(logs, ["service", "source", "nothing"]), "service", "source", "nothing", "count")
    assert got == [("api", "app", "unknown", 1), ("payment", "app", "unknown", 2), ("unknown", "app", "unknown", 1)]


def test_bucket_is_a_key_and_null_without_time(logs):
    rows = a.aggregate(logs, ["level"], bucket="5m").collect()
    got = {(r.level, utc(r.timestamp_bucket)): r["count"] for r in rows}
    assert got == {
        ("INFO", at("2026-05-24T10:00:00")): 1, ("INFO", at("2026-05-24T10:05:00")): 1,
        ("ERROR", at("2026-05-24T11:00:00")): 1, ("ERROR", None): 1,
    }


@pytest.mark.parametrize(
    "text, spec, start",
    [
        ("2026-05-24T10:07:30", "5m", "2026-05-24T10:05:00"),
        ("2026-05-24T10:58:00", "7m", "2026-05-24T10:56:00"),
        ("2026-05-24T10:30:00", "2h", "2026-05-24T10:00:00"),
        ("2026-05-24T23:30:00", "5h", "2026-05-24T20:00:00"),
        ("2026-05-24T10:30:00", "90m", "2026-05-24T10:00:00"),
        ("2026-05-24T10:30:00", "3d", "2026-05-24T00:00:00"),
        ("2026-05-24T10:07:30", "often", "2026-05-24T10:07:30"),
    ],
)
def test_time_bucket(spark, text, spec, start):
    df = spark.createDataFrame([(text,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert utc(df.select(time_bucket(F.col("t"), spec)).first()[0]) == at(start)


def test_zero_bucket_is_refused():
    with pytest.raises(ValueError):
        time_bucket(F.lit(None).cast("timestamp"), "0m")


def test_limit_takes_highest_counts(logs):
    got = a.aggregate(logs, ["service"], limit=2).collect()
    assert [(r.service, r["count"]) for r in got] == [("payment", 2), ("api", 1)]


def test_over_time_needs_a_field(logs):
    with pytest.raises(ValueError):
        a.over_time(logs, "avg")


def test_stats_without_field_counts(logs):
    got = a.stats_by(logs, "avg", ["level"]).collect()
    assert [(r.level, r.value) for r in got] == [("ERROR", 2.0), ("INFO", 2.0)]


def test_facets_keep_top_values_each(entries):
    rows = [{"message": "m", "host_name": h, "zone": z} for h, z in ["ax", "ax", "ay", "bx", "cy"]] + [{"message": "m", "zone": "x"}]
    got = table(a.facet_counts(entries(rows), ["host_name", "zone"], limit=1), "host_name", "zone", "count")
    assert got == [("a", "x", 2)]


def test_summary(logs):
    got = summary.summarize(logs).first()
    assert got["count"] == 4 and got.levels == {"INFO": 2, "ERROR": 2}
    assert got.services == {"payment": 2, "api": 1, "unknown": 1} and got.top_messages == ["a", "b"]
    assert got.summary == (
        "Analyzed 4 log entries. Levels — ERROR: 2, INFO: 2. Services — api: 1, payment: 2, unknown: 1. "
        "Top message: 'a' (3 occurrences)."
    )


def test_summary_of_nothing(logs):
    got = summary.summarize(logs, "no such text").first()
    assert got["count"] == 0 and got.summary == "No logs found matching the criteria."


def test_summary_keeps_all_services_and_five_messages(entries):
    df = entries([{"message": f"m{i % 9}", "service": f"s{i:02d}"} for i in range(30)])
    got = summary.summarize(df).first()
    assert len(got.services) == 30 and got.top_messages == ["m0", "m1", "m2", "m3", "m4"]
