import pytest

from tidelog import sources as src


def test_union(entries):
    a, b = entries([{"message": "1"}]), entries([{"message": "2"}, {"message": "3"}])
    whole = src.union_sources({"a": a, "b": lambda: b})
    assert sorted((r.source, r.message) for r in whole.collect()) == [("a", "1"), ("b", "2"), ("b", "3")]
    assert src.choose_sources(whole, ["b"]).count() == 2 and src.choose_sources(whole).count() == 3


def test_missing_source(entries):
    def broken():
        raise OSError("cannot open")

    good = entries([{"message": "1"}])
    with pytest.raises(KeyError):
        src.union_sources({"a": good, "b": None})
    with pytest.raises(OSError):
        src.union_sources({"a": good, "b": broken})
    assert src.union_sources({"a": good, "b": None, "c": broken}, skip_missing=True).count() == 1
    with pytest.raises(KeyError):
        src.union_sources({"b": None}, skip_missing=True)


def test_health(entries):
    logs = entries([{"message": "x", "timestamp": "2026-05-24T10:00:00Z"}, {"message": "y"}], "live")
    got = {r.source: r for r in src.source_health(logs, ["live", "empty"], ["live", "empty", "other"]).collect()}
    assert [got[s].status for s in ("live", "empty", "other")] == ["healthy", "degraded", "unknown"]
    assert (got["live"].files, got["live"].entries, got["live"].untimed_share) == (1, 2, 0.5)
    assert (got["empty"].entries, got["other"].files) == (0, None)


def test_schema(entries):
    logs = entries([{"message": "x", "n": 1, "ok": True, "env": "p"}, {"message": "y", "n": "2.5", "ok": "no"}])
    got = {r.name: (r.type, r.required, r.entries) for r in src.describe_schema(logs).collect()}
    assert got["timestamp"] == ("timestamp", True, None) and got["service"] == ("string", False, None)
    assert got["n"] == ("number", False, 2) and got["ok"] == ("string", False, 2) and got["env"] == ("string", False, 1)
    kinds = {r.name for r in src.describe_schema(logs, kind="cloudwatch").collect()}
    assert {"@timestamp", "@message", "@logStream", "@logGroup", "n"} <= kinds
    assert src.sample_entry(logs).first().message == "x" and src.describe_schema(logs, "none").count() == 5


def test_nested_keys(spark, entries):
    df = entries([{"a": {"b": {"c": 1}}, "tags": ["x"], "m": 1, "n": None}, {"a": {"b": {"c": 2.5, "d e.f": True}}, "m": "two", "list": [{"k": 1}]}])
    found = {(r.path, r.type) for r in src.nested_keys(df).collect()}
    assert found == {
        ("a", "object"), ("a.b", "object"), ("a.b.c", "number"), ("a.b.d e.f", "boolean"), ("tags", "array"), ("tags[]", "string"),
        ("m", "mixed"), ("n", "null"), ("list", "array"), ("list[]", "object"), ("list[].k", "number"),
    }
    assert src.nested_keys(entries(["plain"])).count() == 0 == src.nested_keys(df, "other").count()
