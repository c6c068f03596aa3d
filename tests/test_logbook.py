"""The micro-fixtures of the tool calls, asked through a log book."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.logbook import LogBook
from tidelog.sources import union_sources

NOW = datetime(2026, 5, 24, 10, 30, tzinfo=timezone.utc)

APP = [
    {"timestamp": "2026-05-24T10:00:00Z", "level": "ERROR", "message": "DB failed", "service": "payment", "trace_id": "t", "duration_ms": 100},
    {"timestamp": "2026-05-24T10:05:00Z", "level": "INFO", "message": "ok", "service": "api", "duration_ms": 200},
    {"timestamp": "2026-05-24T10:10:00Z", "level": "ERROR", "message": "DB failed", "service": "payment", "duration_ms": 300},
]
WEB = [{"timestamp": "2026-05-24T10:00:01Z", "level": "ERROR", "message": "upstream gone", "service": "web", "trace_id": "t"}]


@pytest.fixture
def book(entries):
    logs = union_sources({"app": entries(APP), "web": entries(WEB)}).cache()
    return LogBook(logs, ["app", "web", "empty"], NOW)


def messages(df):
    return [r.message for r in df.orderBy("seq").collect()]


def test_search_filter_tail(book):
    assert messages(book.search("app", "db")) == ["DB failed", "DB failed"]
    assert messages(book.search("app", "", ("now-25m", None))) == ["ok", "DB failed"]
    assert messages(book.search("app", "", limit=1, offset=1)) == ["ok"]
    assert messages(book.filter("app", level="info", custom_fields={"duration_ms": 200})) == ["ok"]
    assert messages(book.tail("app", 2)) == ["ok", "DB failed"]
    assert messages(book.search(None, "gone")) == ["upstream gone"]


def test_unknown_source(book):
    with pytest.raises(KeyError):
        book.search("nope", "x")
    assert book.search("empty", "x").count() == 0


def test_aggregate_and_total(book):
    got = {r.service: (r.value, r["count"]) for r in book.aggregate("app", ["service"], "sum", "duration_ms").collect()}
    assert got == {"payment": (400.0, 2), "api": (200.0, 1)}
    assert book.total("app", ("2026-05-24T10:05:00Z", None)).first()[0] == 2


def test_overview(book):
    assert {r.source: r.entries for r in book.list_sources().collect()} == {"app": 3, "web": 1}
    assert {r.source: r.status for r in book.health("app", "empty", "nope").collect()} == {
        "app": "healthy", "empty": "degraded", "nope": "unknown"}
    assert "duration_ms" in {r.name for r in book.schema("app").collect()}
    assert book.summarize("app").first()["count"] == 3


def test_analysis(book):
    groups = book.correlate(trace_id="t").collect()
    assert [(g.correlation_type, g.entries, g.score) for g in groups] == [("trace_id", 2, 1.0)]
    assert book.correlate(["app"], window="5m").first().entries == 3
    assert book.root_cause("payment", symptom="slow").report.first().error_count == 2
    causes = [r.cause for r in book.root_cause("payment").causes.collect()]
    assert "Errors in upstream service 'web'" in causes and "Infrastructure issue: 'db' detected" in causes
    got = book.compare("app", ("2026-05-24T10:00:00Z", "2026-05-24T10:04:00Z"), ("2026-05-24T10:05:00Z", None)).first()
    assert (got.baseline_total, got.comparison_total) == (1, 2)
    assert book.error_patterns("app", min_occurrences=2).first().pattern == "DB failed"
    assert book.anomalies("app", bucket="1m", sensitivity="high").select(F.count("*")).first()[0] >= 0


def test_usual_ranges_of_stores(entries):
    stamps = ["09:00", "10:00", "10:27"]
    logs = entries([{"timestamp": f"2026-05-24T{t}:00Z", "message": t} for t in stamps], "web")
    plain, remote = LogBook(logs, reference=NOW), LogBook(logs, reference=NOW, stores={"web": "loki"})
    assert messages(plain.search("web", "")) == stamps
    assert messages(remote.search("web", "")) == stamps[1:] and messages(remote.filter("web")) == stamps[1:]
    assert messages(remote.search("web", "", (None, None))) == stamps
    assert messages(remote.tail("web")) == stamps[2:] and messages(plain.tail("web")) == stamps
    assert remote.aggregate("web").first()["count"] == 2
