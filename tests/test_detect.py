import statistics

import pytest
from pyspark.sql import functions as F

from tests.conftest import utc
from tidelog.functions.text import infer_level, template
from tidelog.operators import detect as d


@pytest.mark.parametrize(
    "message, want",
    [
        ("user 42 failed after 3.5s", "user <NUM> failed after <NUM>.<NUM>s"),
        ("id 123e4567-e89b-12d3-a456-426614174000 gone", "id <UUID> gone"),
        ("from 10.0.0.1:8080", "from <IP>:<NUM>"),
        ("at 0xFF and deadbeef01", "at <HEX> and <HEX>"),
        ("plain text", "plain text"),
    ],
)
def test_template(spark, message, want):
    assert spark.range(1).select(template(F.lit(message))).first()[0] == want


@pytest.mark.parametrize(
    "line, want",
    [("error: x", "ERROR"), ("2026 WARNING disk", "WARN"), ("WARN x", "WARN"), ("[INFO] x", "UNKNOWN"),
     ("a debug b", "DEBUG"), ("", "UNKNOWN"), ("trace", "TRACE"), ("an INFO with ERROR inside", "ERROR")],
)
def test_infer_level(spark, line, want):
    assert spark.range(1).select(infer_level(F.lit(line))).first()[0] == want


def error(i, message, service="s", level="ERROR"):
    return {"ts_raw": f"2026-05-24T10:{i:02d}:00Z", "level": level, "message": message, "service": service, "source": "a"}


def test_patterns(made):
    rows = [error(i, f"user {90 - i} failed", "b" if i % 2 else "a") for i in range(6)]
    rows += [error(9, "user 1 failed", None, "error"), error(10, "rare 1"), error(11, "user 5 failed", "a", "INFO")]
    logs = made(*rows)
    got = d.detect_error_patterns(logs).collect()
    assert len(got) == 1 and got[0].pattern == "user <NUM> failed" and got[0]["count"] == 7
    assert got[0].sample_messages == ["user 1 failed", "user 85 failed", "user 86 failed"]
    assert got[0].services == ["a", "b"]
    assert (utc(got[0].first_seen).minute, utc(got[0].last_seen).minute) == (0, 9)
    assert d.total_errors(logs).first()[0] == 8
    assert d.detect_error_patterns(logs, min_occurrences=1).count() == 2
    assert d.detect_error_patterns(logs, service="a", min_occurrences=3).first()["count"] == 3


def test_samples_are_distinct_over_services(made):
    logs = made(*[error(i, f"m {i % 4}", f"s{i % 3}") for i in range(24)])
    assert d.detect_error_patterns(logs).first().sample_messages == ["m 0", "m 1", "m 2"]


def spiky(made):
    rows = [error(0, "m")] * 30
    for hour in (2, 3, 4, 5, 6, 8, 9):
        rows += [{**error(0, "m"), "ts_raw": f"2026-05-24T{10 + hour}:20:00Z"}] * 2
    return made(*rows)


@pytest.mark.parametrize("run", [1, 2, 4096])
@pytest.mark.parametrize("sensitivity, threshold", [("low", 3.0), ("medium", 2.0), ("high", 1.5)])
def test_volume_counts_empty_hours(made, monkeypatch, run, sensitivity, threshold):
    monkeypatch.setattr(d, "FILL_RUN", run)
    volumes = [30, 0, 2, 2, 2, 2, 2, 0, 2, 2]
    mean, sd = statistics.mean(volumes), statistics.stdev(volumes)
    want = {h: v for h, v in enumerate(volumes) if abs(v - mean) / sd / threshold > 1}
    got = d.find_anomalies(spiky(made), sensitivity=sensitivity).collect()
    assert {utc(r.timestamp_bucket).hour - 10: r.actual_value for r in got} == want
    for r in got:
        assert r.expected_value == pytest.approx(mean)
        assert r.deviation_score == pytest.approx(abs(r.actual_value - mean) / sd / threshold)


def test_no_spread_no_points(made):
    assert d.find_anomalies(made(error(0, "m"), error(1, "m")), sensitivity="high", bucket="1m").count() == 0
    assert d.find_anomalies(made(error(0, "m"))).count() == 0


def test_unknown_names(made):
    logs = made(error(0, "m"))
    with pytest.raises(ValueError):
        d.find_anomalies(logs, metric="weather")
    with pytest.raises(ValueError):
        d.find_anomalies(logs, sensitivity="extreme")
