import random

import pytest
from pyspark.sql import functions as F

from tidelog import TimeRange
from tidelog.operators import correlate as c


def stamps(*minutes):
    return [{"ts_raw": f"2026-05-24T10:{m:02d}:00Z", "level": "INFO", "message": str(m), "source": "a"} for m in minutes]


@pytest.mark.parametrize("minutes, groups", [((0, 1, 2), 1), ((0, 10, 20), 3), ((0, 5, 10), 1), ((0, 5, 11), 2), ((7,), 1)])
def test_gaps(made, minutes, groups):
    got = c.correlate_time(made(*stamps(*minutes))).collect()
    assert len(got) == groups and sum(r.entries for r in got) == len(minutes)


def test_key_and_score(made):
    rows = stamps(0, 1, 2, 3)
    rows[0]["level"], rows[1]["level"] = "ERROR", "WARNING"
    got = c.correlate_time(made(*rows)).first()
    assert got.correlation_key == "2026-05-24T10:00:00Z to 2026-05-24T10:03:00Z"
    assert got.score == 0.6 and got.correlation_type == "timestamp_proximity"


def test_score_is_capped(made):
    rows = stamps(0)
    rows[0]["level"] = "ERROR"
    assert c.correlate_time(made(*rows)).first().score == 1.0


def test_no_time_no_group(made):
    rows = stamps(0) + [{"ts_raw": "?", "level": "INFO", "source": "a"}]
    assert c.correlate_time(made(*rows)).first().entries == 1
    assert c.correlate_time(made(rows[1])).count() == 0


def naive(times, gap):
    groups, last = [], None
    for t in sorted(times):
        if last is None or t - last > gap:
            groups.append([])
        groups[-1].append(t)
        last = t
    return [(g[0], g[-1], len(g)) for g in groups]


@pytest.mark.parametrize("block", [1, 3, 65_536])
@pytest.mark.parametrize("gap, window", [(0, "0s"), (1, "1s"), (7, "7s"), (60, "1m"), (100_000, "100000s")])
def test_cells_equal_direct_chaining(spark, monkeypatch, block, gap, window):
    monkeypatch.setattr(c, "CELLS_PER_BLOCK", block)
    rng = random.Random(gap * 10 + block)
    times = [rng.choice([-5000, 0, 90_000]) + rng.randrange(800) for _ in range(150)] + [123] * 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, t long").select(
        "seq", F.timestamp_seconds("t").alias("ts"), F.lit("INFO").alias("level"), F.lit("s").alias("source")
    )
    got = c.correlate_time(df, window).orderBy("group_id").select(
        F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "entries"
    )
    want = naive(times, gap)
    assert [tuple(r) for r in got.collect()] == want
    labelled = c.correlated_entries(df, window).select("group_id", F.unix_seconds("ts").alias("t")).collect()
    starts = {g: min(r.t for r in labelled if r.group_id == g) for g in {r.group_id for r in labelled}}
    assert [starts[g] for g in sorted(starts)] == [w[0] for w in want] and len(labelled) == len(times)


def traced(made):
    rows = stamps(0, 1, 30, 31)
    for row, source, trace, service in zip(rows, "abab", ["t", "t", None, "u"], ["x", "y", "x", None]):
        row.update(source=source, trace_id=trace, service=service)
    return made(*rows)


def test_trace(made):
    logs = traced(made)
    assert [r.seq for r in c.correlate_trace(logs, "t").collect()] == [0, 1]
    assert [r.seq for r in c.correlate_trace(logs, "t", ["b"]).collect()] == [1]
    groups = {r.trace_id: (r.entries, r.sources, r.services) for r in c.trace_groups(logs).collect()}
    assert groups == {"t": (2, 2, 2), "u": (1, 1, 0)}


def test_correlate_passes(made):
    logs = traced(made)
    kinds = lambda **kw: [(r.correlation_type, r.entries) for r in c.correlate(logs, **kw).collect()]
    assert kinds(trace_id="t") == [("trace_id", 2)]
    assert kinds(trace_id="none") == []
    assert kinds() == [("timestamp_proximity", 2), ("timestamp_proximity", 2)]
    assert kinds(trace_id="t", service="x") == [("trace_id", 2), ("timestamp_proximity", 1), ("timestamp_proximity", 1)]
    total = lambda **kw: c.correlate_total(logs, **kw).first()[0]
    assert (total(trace_id="t"), total(), total(trace_id="t", service="x"), total(sources=["a"])) == (2, 4, 6, 2)


def test_range(made):
    logs = traced(made)
    tr = TimeRange.of("2026-05-24T10:00:30Z", "2026-05-24T10:30:00Z")
    assert [r.entries for r in c.correlate_time(logs, tr=tr).collect()] == [1, 1]
