"""Forms that must not grow with what is not in the data: spans of time, distinct names, days."""

import gzip
from datetime import timezone

from pyspark.sql import functions as F

from tidelog import sources as src
from tidelog.logbook import LogBook
from tidelog.operators import correlate, detect, summary
from tidelog.operators.ordering import latest, newest_days
from tidelog.session import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stray_time_builds_no_grid(made):
    logs = made({"ts_raw": "1970-01-01T00:00:00Z", "source": "a"}, {"ts_raw": "2024-01-01T00:00:00Z", "source": "a"})
    model = detect.anomaly_model(logs, bucket="1m").first()
    n = 28_401_121
    assert abs(model.mean - 2 / n) < 1e-15
    assert abs(model.stddev**2 - (2 - 4 / n) / (n - 1)) < 1e-15
    found = detect.find_anomalies(logs, bucket="1m")
    assert found.count() == 2


def test_zeros_by_key_are_found_where_they_are_unusual(made):
    hours = [h for h in range(20) if h != 7]
    rows = [{"ts_raw": f"2024-01-01T{h:02d}:00:00Z", "source": s} for s in ("a", "b") for h in hours for _ in range(5)]
    got = detect.find_anomalies(made(*rows), by=["source"]).collect()
    assert {(r.source, r.timestamp_bucket.astimezone(timezone.utc).hour, r.actual_value) for r in got} == {
        ("a", 7, 0.0), ("b", 7, 0.0)}


def test_traces_are_not_expanded(made):
    groups = correlate.trace_groups(made({"trace_id": "t", "source": "a", "service": "x"}, {"trace_id": "t", "source": "b"}))
    assert "Expand" not in plan_of(groups)
    got = groups.first()
    assert (got.entries, got.sources, got.services) == (2, 2, 1)


def test_summary_of_very_many_services(spark, made):
    one = made({"message": "m", "level": "INFO"})
    logs = one.drop("service").crossJoin(spark.range(100_000).select(F.col("id").cast("string").alias("service")))
    got = summary.summarize(logs).select("count", F.size("services").alias("n"), "top_messages").first()
    assert (got["count"], got.n, got.top_messages) == (100_000, 100_000, ["m"])


def days_table(spark, lines):
    path = shared_dir(spark, "logs")
    values = [{"timestamp": f"2024-01-{d:02d}T00:0{i}:00Z", "message": f"{d}-{i}"} for d in range(1, 6) for i in range(3)]
    src.write_log_table(src.parse_lines(lines([*values, {"message": "untimed"}])), path)
    return src.read_log_table(spark, path)


def test_latest_opens_the_newest_days_only(spark, lines):
    table = days_table(spark, lines)
    for limit in (1, 3, 4, 15, 16, 99):
        want = [r.message for r in latest(table, limit).collect()]
        assert [r.message for r in latest(newest_days(table, limit), limit).collect()] == want
    assert {str(r.dt) for r in newest_days(table, 4).select("dt").distinct().collect()} == {"2024-01-04", "2024-01-05", "None"}
    book, seen, cursor = LogBook(table), [], None
    while rows := book.page("app", cursor, 5).collect():
        seen += [r.message for r in rows]
        cursor = book.cursor(rows[-1].ts and rows[-1].ts.astimezone(timezone.utc), rows[-1].seq, rows[-1].source)
    assert seen == [f"{d}-{i}" for d in range(5, 0, -1) for i in (2, 1, 0)] + ["untimed"]


def test_entries_of_groups(made):
    stamps = ["10:00:00", "10:01:00", "10:30:00"]
    logs = made(*[{"ts_raw": f"2024-01-01T{t}Z", "source": "a", "service": "s", "trace_id": "t" if t > "10:10" else None,
                   "message": t} for t in stamps])
    book = LogBook(logs)
    groups = {r.group_id: r.entries for r in book.correlate(trace_id="t", service="s").collect()}
    assert groups == {0: 1, 1: 2, 2: 1}
    for group, n in groups.items():
        assert book.correlate_entries(trace_id="t", service="s", group_id=group).count() == n
    assert book.correlate_entries(trace_id="t", service="s").count() == 4
    assert book.correlate_entries(trace_id="t", group_id=1).count() == 0


def test_messages_of_one_period_only(made):
    logs = made(*[{"ts_raw": f"2024-01-0{d}T00:00:00Z", "source": "a", "message": m} for d, m in ((1, "x"), (1, "y"), (2, "y"), (2, "z"))])
    first, second = ("2024-01-01T00:00:00Z", "2024-01-01T23:00:00Z"), ("2024-01-02T00:00:00Z", None)
    changes = LogBook(logs).compare_messages("a", first, second)
    assert ([r.message for r in changes.new.collect()], [r.message for r in changes.disappeared.collect()]) == (["z"], ["x"])


def test_files_that_cannot_be_read(spark, tmp_path):
    for name in ("good", "blank", "bad"):
        (tmp_path / name).mkdir()
    (tmp_path / "good" / "a.log").write_text("one\ntwo\n")
    (tmp_path / "blank" / "a.log").write_text("\n")
    (tmp_path / "bad" / "a.log").write_text("one\n")
    (tmp_path / "bad" / "b.log.gz").write_bytes(gzip.compress(b"two\n")[:1] + b"no gzip at all")
    ids = ["good", "blank", "bad"]
    files = src.union_sources({s: src.log_files(spark, f"{tmp_path}/{s}/*", s) for s in ids})
    logs = src.union_sources({s: src.plain_lines(src.read_log_lines(spark, f"{tmp_path}/{s}/*", s)) for s in ids})
    got = {r.source: (r.status, r.files, r.unreadable) for r in src.source_health(logs, ids, files=files).collect()}
    assert got == {"good": ("healthy", 1, 0), "blank": ("healthy", 1, 0), "bad": ("degraded", 2, 1)}


def test_true_types_and_formats(entries):
    logs = entries([{"message": "x", "zip": "0042", "a": [1], "o": {"k": 1}, "n": 1, "b": True, "mixed": 1},
                    {"message": "y", "zip": "0043", "a": [], "o": {}, "n": 2, "b": False, "mixed": [1]}, "plain"])
    got = {r.name: r.type for r in src.describe_schema(logs).collect()}
    assert {k: got[k] for k in ("zip", "a", "o", "n", "b", "mixed")} == {
        "zip": "string", "a": "array", "o": "object", "n": "number", "b": "boolean", "mixed": "string"}
    assert {r.format: r.entries for r in src.known_formats(logs).collect()} == {"json": 2, "regex": 0}
