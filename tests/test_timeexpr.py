from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, strategies as st

from tidelog.functions.timeexpr import (
    TimeRange,
    default_range,
    parse_delta,
    parse_width,
    parse_window,
    resolve_time,
)

REF = datetime(2026, 5, 24, 10, 30, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "text, seconds",
    [("1h", 3600), ("1d2h30m5s", 95405), ("1.5h", 5400), ("", 0), ("0.5s", 0.5), (" 2m ", 120)],
)
def test_delta(text, seconds):
    assert parse_delta(text) == timedelta(seconds=seconds)


@pytest.mark.parametrize("text", ["h", "5", "5x", "1h5", "1.2.3h", "-1h"])
def test_bad_delta(text):
    with pytest.raises(ValueError):
        parse_delta(text)


@pytest.mark.parametrize(
    "text, moment",
    [
        ("now", REF),
        ("NOW-1h", REF - timedelta(hours=1)),
        ("now+30m", REF + timedelta(minutes=30)),
        ("2026-05-24t10:00:00z", REF - timedelta(minutes=30)),
        ("2026-05-24T12:00:00+02:00", REF - timedelta(minutes=30)),
        ("2026-05-24", datetime(2026, 5, 24, tzinfo=timezone.utc)),
    ],
)
def test_resolve(text, moment):
    assert resolve_time(text, REF) == moment


@pytest.mark.parametrize("text", ["yesterday", "now*1h", "nowish", "now-1y"])
def test_bad_time(text):
    with pytest.raises(ValueError):
        resolve_time(text, REF)


@pytest.mark.parametrize(
    "text, seconds", [("5m", 300), ("1h", 3600), ("30s", 30), ("10", 600), ("h", 18000), ("", 300), ("2d", 120)]
)
def test_window(text, seconds):
    assert parse_window(text) == timedelta(seconds=seconds)


def test_width_must_be_positive():
    with pytest.raises(ValueError):
        parse_width("0m")


def test_default_ranges():
    assert default_range("local", "search", REF) == TimeRange()
    assert default_range("loki", "filter", REF) == TimeRange(REF - timedelta(hours=1), REF)
    assert default_range("datadog", "tail", REF) == TimeRange(REF - timedelta(minutes=5), REF)
    assert default_range("cloudwatch", "tail", REF).start == datetime(2026, 5, 24, 9, tzinfo=timezone.utc)


@given(st.integers(0, 50), st.integers(0, 50), st.integers(0, 50), st.integers(0, 50))
def test_delta_adds_up(d, h, m, s):
    assert parse_delta(f"{d}d{h}h{m}m{s}s") == timedelta(days=d, hours=h, minutes=m, seconds=s)
