import pytest
from pyspark.sql import functions as F

from tests.conftest import utc
from tidelog.operators import ordering as o


@pytest.fixture
def logs(entries):
    """Times fall while `seq` rises, every third time is unreadable, and there are ties."""
    def stamp(i):
        return "?" if i % 3 == 2 else f"2026-05-24T10:{(59 - i // 2):02d}:00Z"

    return entries([{"timestamp": stamp(i), "level": "INFO", "message": f"line {i}"} for i in range(60)]).cache()


def seqs(df):
    return [r.seq for r in df.collect()]


def newest_first(rows):
    return sorted(rows, key=lambda r: (r.ts is not None, r.ts.timestamp() if r.ts else 0, r.seq), reverse=True)


def test_latest(logs):
    want = [r.seq for r in newest_first(logs.collect())]
    assert seqs(o.latest(logs, 25)) == want[:25]
    assert seqs(o.latest(logs, 100)) == want


def test_pages_by_cursor_cover_everything(logs):
    want, got, cursor = [r.seq for r in newest_first(logs.collect())], [], None
    while True:
        page = o.page_after(logs, cursor, 7).collect()
        got += [r.seq for r in page]
        if len(page) < 7:
            break
        cursor = o.encode_cursor(utc(page[-1].ts), page[-1].seq)
    assert got == want


def test_pages_over_sources_with_equal_seq(logs):
    both = logs.withColumn("source", F.lit("a")).unionByName(logs.withColumn("source", F.lit("b")))
    got, cursor = [], None
    while True:
        page = o.page_after(both, cursor, 7).collect()
        got += [(r.seq, r.source) for r in page]
        if len(page) < 7:
            break
        cursor = o.encode_cursor(utc(page[-1].ts), page[-1].seq, page[-1].source)
    assert len(got) == len(set(got)) == 120
    assert [r.source for r in o.first_matches(both, 4).collect()] == ["a", "b", "a", "b"]


def test_offset(logs):
    assert seqs(o.first_matches(logs, 2, 1)) == [1, 2]
    assert seqs(o.first_matches(logs, 10, 55)) == [55, 56, 57, 58, 59]
    assert o.next_offset(10, 20, 10) == 30 and o.next_offset(10, 20, 9) is None


@pytest.mark.parametrize("limit, offset", [(5, 0), (5, 3), (20, 17), (10, 38), (3, 39), (5, 40), (5, 100)])
def test_deep_offset_gives_the_same_page(logs, monkeypatch, limit, offset):
    matches = logs.where(F.col("seq") % 3 != 1)
    want = seqs(o.first_matches(matches, limit, offset))
    monkeypatch.setattr(o, "SEQ_BLOCK", 8)
    page = o.first_matches(matches, limit, offset)
    assert seqs(page) == want and page.columns == matches.columns


def test_tail_uses_ingest_order(logs):
    assert seqs(o.tail(logs, 5)) == [55, 56, 57, 58, 59]
    assert seqs(o.tail(logs, 3, "line 1")) == [17, 18, 19]


def test_top_n_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2.0, 2), ("a", 2.0, 2), ("c", 9.0, 9)], "k string, value double, count long")
    assert [r.k for r in o.top_n(df, 2).collect()] == ["c", "a"]


@pytest.mark.parametrize("threshold", [1000, 1])
def test_top_per_source(logs, monkeypatch, threshold):
    logs.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    two = logs.withColumn("source", F.when(F.col("seq") < 50, "big").otherwise("small"))
    got = o.top_per_source(two, 4).collect()
    for source in ("big", "small"):
        rows = [r for r in two.collect() if r.source == source]
        rows.sort(key=lambda r: (r.ts is None, r.ts.timestamp() if r.ts else 0, r.seq))
        assert sorted(r.seq for r in got if r.source == source) == sorted(r.seq for r in rows[:4])


def test_timeline(logs):
    got = o.timeline(logs).collect()
    times = [r.ts for r in got]
    assert times[:40] == sorted(times[:40]) and times[40:] == [None] * 20
