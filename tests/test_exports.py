import json

import pytest

from tests.conftest import at, utc
from tidelog import sources as src


@pytest.fixture
def responses(spark):
    return lambda *objects: spark.createDataFrame([(json.dumps(o),) for o in objects], "value string")


def first(df):
    return df.first().asDict()


def test_datadog(responses):
    item = {"id": "1", "type": "log", "attributes": {
        "timestamp": "2026-05-24T10:00:00Z", "status": "error", "service": "pay", "host": "h", "message": "boom",
        "attributes": {"trace_id": "", "traceId": "t", "spanId": "s", "code": 7, "env": "dev", "none": None},
        "tags": ["env:prod", "plain", "url:http://x", "env:last"]}}
    got = first(src.normalize_datadog(responses({"data": [item]})))
    assert (got["level"], got["message"], got["service"], got["host"], got["trace_id"]) == ("ERROR", "boom", "pay", "h", "t")
    assert got["fields"] == {"code": "7", "env": "last", "url": "http://x"} and got["source"] == "datadog"
    assert utc(got["ts"]) == at("2026-05-24T10:00:00")
    assert "7" not in got["search_text"] and "last" in got["search_text"]


def test_datadog_gaps(responses):
    df = src.normalize_datadog(responses({"data": [{"attributes": {"attributes": "text"}}]}, {"data": []}, {}))
    got = first(df)
    assert df.count() == 1 and (got["level"], got["message"], got["fields"], got["trace_id"]) == ("UNKNOWN", "", {}, None)


def loki(*values, **labels):
    return {"status": "success", "data": {"resultType": "streams", "result": [{"stream": labels, "values": list(values)}]}}


def test_loki_plain_line(responses):
    got = first(src.normalize_loki(responses(loki(["1779616800123456789", "boom"], service="pay", level="error"))))
    assert (got["message"], got["level"], got["service"]) == ("boom", "UNKNOWN", "pay")
    assert got["fields"] == {"service": "pay", "level": "error"}
    assert got["ts_raw"] == "2026-05-24T10:00:00.123456Z"


def test_loki_json_line_overrides_labels(responses):
    line = json.dumps({"msg": "m", "severity": "warn", "service": "api", "traceId": "t", "env": "prod", "n": 1, "span_id": "s"})
    got = first(src.normalize_loki(responses(loki(["1779616800000000000", line], service="pay", env="dev"))))
    assert (got["message"], got["level"], got["service"], got["trace_id"]) == ("m", "WARN", "api", "t")
    assert got["fields"] == {"service": "pay", "env": "prod", "n": "1"}
    assert got["ts_raw"] == "2026-05-24T10:00:00Z"


def cells(**values):
    return [{"field": k.replace("at_", "@"), "value": v} for k, v in values.items()]


@pytest.mark.parametrize(
    "message, level, service, fields",
    [
        (json.dumps({"level": "error", "service": "pay", "env": "p", "message": "x"}), "ERROR", "pay", {"env": "p"}),
        (json.dumps({"level": "info"}), "INFO", "stream", {}),
        ("WARNING low disk", "WARN", "stream", {}),
        ('["an ERROR here"]', "UNKNOWN", "stream", {}),
        ('{"level": "info"} ERROR tail', "UNKNOWN", "stream", {}),
        ('{"level": "info"} ERROR tail x', "ERROR", "stream", {}),
    ],
)
def test_cloudwatch_messages(responses, message, level, service, fields):
    if message.endswith("ERROR tail"):
        message = message.replace(" ERROR", " error-")
    rows = [cells(at_timestamp="2026-05-24 10:00:00.000", at_message=message, at_logStream="stream")]
    got = first(src.normalize_cloudwatch(responses({"results": rows})))
    assert (got["level"], got["service"], got["host"], got["fields"]) == (level, service, "stream", fields)
    assert got["message"] == message and utc(got["ts"]) == at("2026-05-24T10:00:00")


def test_cloudwatch_without_stream(responses):
    got = first(src.normalize_cloudwatch(responses({"results": [cells(at_message='{"a": 1}')]})))
    assert (got["service"], got["host"], got["ts"]) == ("unknown", None, None)
    assert first(src.normalize_cloudwatch(responses({"results": [cells(at_message="x")]})))["service"] is None


def test_cloudwatch_events(responses):
    events = [{"timestamp": 1779616800500, "message": "ERROR x", "logStreamName": "st"}, {"message": "y"}]
    got = [r.asDict() for r in src.normalize_cloudwatch_events(responses({"events": events})).orderBy("ts_raw").collect()]
    assert (got[1]["ts_raw"], got[1]["level"], got[1]["service"], got[1]["host"]) == ("2026-05-24T10:00:00.500000Z", "ERROR", "st", "st")
    assert (got[0]["ts_raw"], got[0]["service"], got[0]["host"]) == ("1970-01-01T00:00:00Z", "unknown", None)


def buckets(df):
    return sorted((sorted(r.key.items()), r.value, r["count"]) for r in df.collect())


def test_datadog_buckets(responses):
    rows = [
        {"by": {"service": "pay"}, "aggregations": [{"value": 5}, {"metric": "x"}, {"value": "bad"}]},
        {"by": {"service": "api"}, "aggregations": [{"value": 2.5}]},
        {"by": {"service": "web"}, "aggregations": []},
    ]
    want = [([("service", "api")], 2.5, 1), ([("service", "pay")], 5.0, 5), ([("service", "web")], 0.0, 0)]
    assert buckets(src.normalize_buckets(responses({"data": {"buckets": rows}}), "datadog")) == want
    assert buckets(src.normalize_buckets(responses({"data": rows}), "datadog")) == want


def metric(kind, *result):
    return {"data": {"resultType": kind, "result": list(result)}}


def test_loki_buckets(responses):
    vector = metric("vector", {"metric": {"a": "x"}, "value": [0, "4"]}, {"metric": {"a": "y"}, "value": [0, "1.5"]},
                    {"metric": {"a": "z"}, "value": [0, "oops"]})
    assert buckets(src.normalize_buckets(responses(vector), "loki")) == [
        ([("a", "x")], 4.0, 4), ([("a", "y")], 1.5, 1), ([("a", "z")], 0.0, 0)]
    matrix = metric("matrix", {"metric": {"a": "x"}, "values": [[1, "10"], [2, "20"]]}, {"metric": {"a": "y"}, "values": []},
                    {"metric": {}, "values": [[1, "10"], [2, "?"]]})
    assert buckets(src.normalize_buckets(responses(matrix), "loki")) == [([], 0.0, 2), ([("a", "x")], 30.0, 2)]


def row(**values):
    return [{"field": k, "value": v} for k, v in values.items()]


def test_insights_buckets(responses):
    rows = [
        [{"field": "bin(5m)", "value": "10:00"}, {"field": "count()", "value": "7"}],
        [{"field": "@logStream", "value": "s"}, {"field": "avg(x)", "value": "2.5"}],
        [{"field": "@logStream", "value": "t"}, {"field": "sum()", "value": "bad"}],
    ]
    assert buckets(src.normalize_buckets(responses({"results": rows}), "insights")) == [
        ([("@logStream", "s"), ("avg(x)", "2.5")], 2.5, 1), ([("@logStream", "t")], 0.0, 0), ([("bin(5m)", "10:00")], 7.0, 7)]


def test_unknown_kind(responses):
    with pytest.raises(ValueError):
        src.normalize_buckets(responses({}), "csv")
