import os

import pytest
from pyspark.sql import functions as F

from tidelog import sources as src
from tidelog.sources.lines import compile_pattern


def by_seq(df):
    return [r.asDict() for r in df.orderBy("seq").collect()]


def test_json_object_becomes_entry(entries):
    got = by_seq(entries([{
        "timestamp": "2026-05-24T10:00:00Z", "level": "error", "message": "boom", "service": "payment",
        "host": "h1", "traceId": "t1", "span_id": "s1", "env": "prod", "n": 3, "ok": True, "none": None,
        "deep": {"a": [1, 2]},
    }], host_field="host"))[0]
    assert (got["level"], got["message"], got["service"], got["host"]) == ("ERROR", "boom", "payment", "h1")
    assert (got["trace_id"], got["span_id"]) == ("t1", "s1")
    assert got["fields"] == {
        "message": "boom", "env": "prod", "n": "3", "ok": "true", "deep": '{"a":[1,2]}'
    }
    assert got["search_text"] == "\u0001".join(["boom", "payment", "h1", "boom", "prod"])


def test_host_stays_a_field_without_host_option(entries):
    got = by_seq(entries([{"message": "m", "host": "h"}]))[0]
    assert got["host"] is None and got["fields"]["host"] == "h"


def test_message_choice(entries):
    got = by_seq(entries([
        {"text": "t", "msg": "m"}, {"body": "b", "log": "l"}, {"level": "INFO", "x": 1}, {"what": "w", "message": "m"},
    ], message_field="what"))
    assert [r["message"] for r in got] == ["m", "l", '{"level": "INFO", "x": 1}', "w"]
    assert got[3]["fields"] == {"message": "m"}


@pytest.mark.parametrize("value", ["", 0, 0.0, False, None, {}, []])
def test_empty_ids_are_null(entries, value):
    got = by_seq(entries([{"message": "m", "service": value, "trace_id": value, "traceId": "other"}]))[0]
    assert got["service"] is None and got["trace_id"] == "other"


def test_text_zero_is_not_empty(entries):
    assert by_seq(entries([{"message": "m", "service": "0", "trace_id": "false"}]))[0]["service"] == "0"


@pytest.mark.parametrize(
    "line", ["[1, 2, 3]", "3", '"s"', '{"a":', '{"a": 1} x', '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', "{'a': 1}", "plain"]
)
def test_other_lines_are_plain(lines, line):
    got = by_seq(src.parse_lines(lines([line])))[0]
    assert (got["message"], got["level"], got["ts"], got["fields"], got["raw"]) == (line, "UNKNOWN", None, {}, None)


def test_repeated_key_keeps_last_value(lines):
    got = by_seq(src.parse_lines(lines(['{"a": 1, "level": "x", "a": 2, "level": "warn"}'])))[0]
    assert got["fields"] == {"a": "2"} and got["level"] == "WARN"


def test_missing_or_null_level(entries):
    got = by_seq(entries([{"message": "m"}, {"message": "m", "level": None}, {"message": "m", "level": "odd"}]))
    assert [r["level"] for r in got] == ["UNKNOWN", "UNKNOWN", "ODD"]


@pytest.mark.parametrize(
    "text, iso",
    [
        ("2026-05-24T10:00:00Z", "2026-05-24T10:00:00Z"),
        ("2026-05-24T10:00:00.25Z", "2026-05-24T10:00:00.250000Z"),
        ("2026-05-24T10:00:00+0200", "2026-05-24T08:00:00Z"),
        ("2026-05-24T10:00:00.5-05:30", "2026-05-24T15:30:00.500000Z"),
        ("2026-05-24 10:00:00", "2026-05-24T10:00:00Z"),
        ("2026-05-24 10:00:00.123456", "2026-05-24T10:00:00.123456Z"),
        ("2026-05-24T10:00:00", "2026-05-24T10:00:00Z"),
        ("2026-05-24", None), ("2026", None), ("2026-05-24T10:000:00Z", None), ("1716544800", None),
        ("2026-05-24 10:00:00Z", None), ("2026-13-24T10:00:00Z", None), ("2026-05-24T10:00:00.1234567Z", None),
    ],
)
def test_timestamp_layouts(spark, text, iso):
    from tidelog.functions.timestamps import iso_text, parse_ts

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(iso_text(parse_ts(F.col("t")))).first()[0] == iso


PATTERN = r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(?P<level>\w+)\] (?P<service_name>[\w(?P<>]+): (?P<message>.*)"


def test_regex_line(lines):
    opts = src.LineOptions(service_field="service_name")
    df = lines(["2026-05-24 10:00:00 [ERROR] payment: DB failed", "x 2026-05-24 10:00:00 [ERROR] payment: no"])
    got = by_seq(src.parse_lines(df, json=False, pattern=PATTERN, opts=opts))
    assert (got[0]["level"], got[0]["service"], got[0]["message"]) == ("ERROR", "payment", "DB failed")
    assert got[0]["ts"] is not None and got[0]["raw"].startswith("2026")
    assert got[1]["level"] == "UNKNOWN" and got[1]["ts"] is None
    only = by_seq(src.parse_regex_lines(df, PATTERN, opts))
    assert len(only) == 1


def test_regex_without_message_group(lines):
    got = by_seq(src.parse_lines(lines(["a=1 b="]), json=False, pattern=r"a=(?P<x>\d) b=(?P<y>\d)?"))[0]
    assert got["message"] == '{"x":"1"}' and got["fields"] == {"x": "1"}


def test_compile_pattern():
    java, names = compile_pattern(r"(\d)(?P<a_b>x)[(?P<]\((?P=a_b)")
    assert java == r"(\d)(x)[(?P<]\(\2" and names == {"a_b": 2}


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_read_lines(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/a.log", b"  one \t\n\n   \nbad \xff byte\r\nlast")
    write(f"{root}/b.txt", b"other\n")
    write(f"{root}/sub/deep/c.log", b"deep\n")
    read = lambda *paths: sorted(r.value for r in src.read_log_lines(spark, list(paths), "s").collect())
    assert read(f"{root}/*.log") == ["bad � byte", "last", "one"]
    assert read(f"{root}/**/*.log") == ["bad � byte", "deep", "last", "one"]
    assert read(f"{root}/**/deep/*.log") == ["deep"]
    assert read(f"{root}/nothing/*.log") == []
    assert read(f"{root}/*.txt", f"{root}/none") == ["other"]
    assert read(f"{root}/*.log", f"{root}/a.*", f"{root}/**/*.log", f"{root}/**") == [
        "bad � byte", "deep", "last", "one", "other"
    ]
    assert read(f"{root}/sub/deep", f"{root}/**/*.log") == ["bad � byte", "deep", "last", "one"]
    unique = src.read_log_lines(spark, [f"{root}/*.log", f"{root}/**/*.log"], "s").select("line_pos")
    assert unique.distinct().count() == unique.count() == 4


def test_seq_follows_path_and_line_over_split_files(spark, tmp_path):
    """Small splits and a big last file: Spark then reads neither files nor splits in order."""
    root, want = str(tmp_path), []
    for name, n in (("a", 3), ("b", 700), ("c", 1), ("d", 1500)):
        rows = [f'{{"message": "{name}{i:05d}"}}' for i in range(n)]
        write(f"{root}/logs/{name}.log", "\n".join(rows).encode())
        want += [f"{name}{i:05d}" for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        parsed = src.parse_lines(src.read_log_lines(spark, f"{root}/logs/*.log", "app"))
        assert parsed.rdd.getNumPartitions() > 4
        src.write_log_table(parsed, f"{root}/table")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    table = src.read_log_table(spark, f"{root}/table")
    got = table.orderBy("seq").collect()
    assert [r.message for r in got] == want
    assert [r.seq for r in got] == list(range(len(want)))


def test_table_prunes_days(spark, tmp_path, entries):
    from tidelog import TimeRange
    from tidelog.operators.predicates import in_time_range

    rows = [{"timestamp": f"2026-05-{d:02d}T10:00:00Z", "message": str(d)} for d in range(1, 6)] + [{"message": "none"}]
    src.write_log_table(entries(rows).drop("line_pos", "file_path", "block_start"), str(tmp_path / "t"))
    table = src.read_log_table(spark, str(tmp_path / "t"))
    found = in_time_range(table, TimeRange.of("2026-05-02T10:00:00Z", "2026-05-03T10:00:00Z"))
    assert sorted(r.message for r in found.collect()) == ["2", "3", "none"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(dt" in plan or "dt#" in plan.split("PartitionFilters")[1][:80]


def test_plain_lines(lines):
    got = by_seq(src.plain_lines(lines(['{"a": 1}', "x"])))
    assert [r["message"] for r in got] == ['{"a": 1}', "x"]
