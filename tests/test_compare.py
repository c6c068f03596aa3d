import math

import pytest

from tidelog import TimeRange
from tidelog.functions.values import percent_change, two_decimals
from tidelog.operators import compare as cmp
from pyspark.sql import functions as F

B = TimeRange.of("2026-05-24T10:00:00Z", "2026-05-24T10:09:00Z")
C = TimeRange.of("2026-05-24T10:10:00Z", "2026-05-24T10:19:00Z")


def row(minute, message, level="INFO", service="s"):
    return {"ts_raw": f"2026-05-24T10:{minute:02d}:00Z", "level": level, "message": message, "service": service, "source": "a"}


@pytest.mark.parametrize("b, c, want", [(0, 0, 0.0), (0, 5, math.inf), (10, 10, 0.0), (5, 10, 100.0), (10, 5, -50.0), (3, 4, 33.33)])
def test_percent(spark, b, c, want):
    df = spark.createDataFrame([(b, c)], "b long, c long")
    assert df.select(percent_change(F.col("b"), F.col("c"))).first()[0] == want


@pytest.mark.parametrize("value, text", [(100.0, "100.0"), (66.67, "66.67"), (12345678.5, "12345678.5"), (0.0, "0.0")])
def test_percent_text(spark, value, text):
    assert spark.range(1).select(two_decimals(F.lit(value))).first()[0] == text


def test_more_of_everything(made):
    logs = made(row(1, "old"), row(2, "both", "ERROR"), row(11, "both", "ERROR"), row(12, "new", "WARN", None),
                row(13, "new", "WARNING"), row(14, "fresh"), row(30, "outside"))
    got = cmp.compare_periods(logs, B, C).first().asDict(True)
    assert (got["baseline_total"], got["comparison_total"], got["total_change"]) == (2, 4, 100.0)
    assert (got["baseline_errors"], got["comparison_errors"], got["error_change"]) == (1, 3, 200.0)
    assert (got["baseline_rate"], got["comparison_rate"], got["rate_change"]) == (0.5, 0.75, 0.25)
    assert got["top_messages_comparison"] == [{"key": "new", "count": 2}, {"key": "both", "count": 1}, {"key": "fresh", "count": 1}]
    assert got["services_comparison"] == [{"key": "s", "count": 3}, {"key": "unknown", "count": 1}]
    assert (got["new_messages"], got["disappeared_messages"]) == (2, 1)
    assert got["summary"] == (
        "Log volume increased by 100.0%. Errors increased by 200.0%. New messages appeared: fresh, new."
    )


def test_from_nothing(made):
    got = cmp.compare_periods(made(row(11, "m", "ERROR")), B, C).first()
    assert got.total_change == math.inf
    assert got.summary == "Log volume went from zero to present. Errors went from zero to present. New messages appeared: m."


def test_nothing_at_all(made):
    got = cmp.compare_periods(made(row(50, "m")), B, C).first()
    assert (got.baseline_total, got.new_messages, got.top_messages_baseline) == (0, 0, [])
    assert got.summary == "Log volume is relatively stable. Error rate is relatively stable."


def test_decrease_and_half_is_stable(made):
    rows = [row(1, "m", "ERROR")] * 4 + [row(11, "m", "ERROR"), row(12, "m")]
    got = cmp.compare_periods(made(*rows), B, C).first()
    assert got.summary == "Log volume is relatively stable. Errors decreased by 75.0%."


def test_message_sets(made):
    rows = [row(1, f"b{i}") for i in range(7)] + [row(11, f"c{i}") for i in range(9)] + [row(2, "x"), row(12, "x")]
    counts = cmp.period_counts(made(*rows), B, C)
    assert sorted(r[0] for r in cmp.new_messages(counts).collect()) == [f"c{i}" for i in range(9)]
    assert sorted(r[0] for r in cmp.disappeared_messages(counts).collect()) == [f"b{i}" for i in range(7)]
    assert [r["key"] for r in cmp.top_keys(counts, cmp.MESSAGE, "baseline").collect()] == ["b0", "b1", "b2", "b3", "b4"]


def test_overlap_counts_in_both(made):
    counts = cmp.period_counts(made(row(5, "m")), B, TimeRange.of("2026-05-24T10:05:00Z"))
    total = counts.where("kind = 'total'").first()
    assert (total.baseline, total.comparison) == (1, 1)


def test_period_stats(made):
    got = cmp.period_stats(made(row(1, "a", "ERROR"), row(2, "b"), row(3, "b")), B).first()
    assert (got.total, got.errors, got.error_rate) == (3, 1, 0.3333)
    assert cmp.period_stats(made(row(40, "a")), B).first().error_rate == 0.0
