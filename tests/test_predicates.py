import pytest
from pyspark.sql import functions as F

from tidelog import TimeRange
from tidelog.operators import predicates as p

ROWS = [
    {"timestamp": "2026-05-24T10:00:00Z", "level": "ERROR", "message": "Payment failed", "service": "payment", "env": "prod"},
    {"timestamp": "2026-05-24T10:05:00Z", "level": "INFO", "message": "ok", "service": "api", "env": "dev", "n": 42},
    {"timestamp": "2026-05-24T10:10:00Z", "level": "WARN", "message": "slow", "service": "payment", "trace_id": "t9", "flag": True},
    {"timestamp": "2026-05-24T10:000:00Z", "level": "DEBUG", "message": "broken time"},
]


@pytest.fixture
def logs(entries):
    return entries(ROWS).cache()


def hits(df):
    return sorted(r.seq for r in df.collect())


@pytest.mark.parametrize(
    "query, want",
    [("FAILED", [0]), ("pay", [0, 2]), ("error", [0]), ("err", []), ("PROD", [0]), ("42", []), ("t9", []), ("app", []), ("", [0, 1, 2, 3])],
)
def test_search(logs, query, want):
    assert hits(p.search(logs, query)) == want


def test_search_does_not_join_neighbours(entries):
    df = entries([{"message": "ab", "service": "cd"}])
    assert hits(p.search(df, "bc")) == []


def test_range_is_inclusive_and_keeps_unreadable_times(logs):
    tr = TimeRange.of("2026-05-24T10:00:00Z", "2026-05-24T10:05:00Z")
    assert hits(p.in_time_range(logs, tr)) == [0, 1, 3]
    assert hits(p.in_time_range(logs, TimeRange.of("2026-05-24T10:05:00Z"))) == [1, 2, 3]
    assert hits(p.in_time_range(logs, TimeRange.of(end="2026-05-24T10:04:59Z"))) == [0, 3]
    assert hits(p.in_time_range(logs, None)) == [0, 1, 2, 3]


@pytest.mark.parametrize(
    "conditions, want",
    [
        ({"level": "error"}, [0]),
        ({"service": "payment"}, [0, 2]),
        ({"service": "Payment"}, []),
        ({"service": "payment", "level": "WARN"}, [2]),
        ({"trace_id": "t9"}, [2]),
        ({"custom_fields": {"env": "prod"}}, [0]),
        ({"custom_fields": {"n": 42}}, [1]),
        ({"custom_fields": {"flag": True}}, [2]),
        ({"custom_fields": {"missing": "x"}}, []),
        ({}, [0, 1, 2, 3]),
    ],
)
def test_filter(logs, conditions, want):
    assert hits(p.filter_logs(logs, **conditions)) == want
    renamed = {{"level": "status", "custom_fields": "attributes"}.get(k, k): v for k, v in conditions.items()}
    assert hits(p.filter_attributes(logs, **renamed)) == want


def test_line_probes(logs):
    assert hits(p.line_contains(logs, "failed")) == [0]
    assert hits(p.line_contains(logs, "FAILED")) == []
    assert hits(p.line_contains(logs, '"n": 42')) == [1]
    assert hits(p.line_matches(logs, "^[A-Z]")) == [0]


def test_labels_replace_defaults(logs):
    assert hits(p.match_labels(logs, None, {"service": "api"})) == [1]
    assert hits(p.match_labels(logs, {"level": "Error"}, {"service": "api"})) == [0]
    assert hits(p.match_labels(logs, {"service": "payment"}, None, {"flag": "true"}, "t9")) == [2]


def test_stream_probes(spark):
    rows = [
        (0, '{"level":"ERROR","trace_id":"a"}', "api-1"),
        (1, '{"level": "ERROR", "k": "v"}', "api-2"),
        (2, 'ERROR plain "k":"v"', "db-1"),
        (3, '{"traceId":"a"}', "db-2"),
    ]
    df = spark.createDataFrame(rows, "seq long, message string, host string").withColumn("ts", F.lit(None).cast("timestamp"))
    assert hits(p.filter_stream(df, level="ERROR")) == [0, 1, 2]
    assert hits(p.filter_stream(df, level="ERROR", service="api")) == [0, 1]
    assert hits(p.filter_stream(df, trace_id="a")) == [0, 3]
    assert hits(p.filter_stream(df, custom_fields={"k": "v"})) == [1, 2]
    assert hits(p.filter_stream(df, host="-1$", level="ERROR")) == [0, 2]
