"""Landed responses of hosted log stores, one JSON response per row in the column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import infer_level
from ..functions.timestamps import iso_text, parse_ts
from ..functions.values import blank_to_null, last_wins, overlay
from ..schema import UNKNOWN, UNKNOWN_LEVEL, conform
from . import documents as docs

# Keys of a JSON message that belong to the envelope, by store.
DATADOG_ENVELOPE = ("trace_id", "traceId", "span_id", "spanId")
LOKI_ENVELOPE = (
    "message", "msg", "level", "severity", "service", "host",
    "trace_id", "traceId", "span_id", "spanId", "timestamp",
)
CLOUDWATCH_ENVELOPE = (
    "timestamp", "level", "message", "service", "host",
    "traceId", "trace_id", "spanId", "span_id",
)

_DATADOG = (
    "data array<struct<id:string, type:string, attributes:struct<timestamp:string, "
    "message:string, status:string, service:string, host:string, attributes:variant, "
    "tags:array<string>>>>"
)
_LOKI = "data struct<result:array<struct<stream:map<string,string>, values:array<array<string>>>>>"
_CELLS = "array<struct<field:string, value:string>>"
_INSIGHTS = f"results array<{_CELLS}>"
_EVENTS = "events array<struct<timestamp:bigint, message:string, logStreamName:string>>"


def _empty_document() -> Column:
    return F.create_map().cast("map<string,struct<text:string,is_text:boolean>>")


def _finish(df: DataFrame, source: str) -> DataFrame:
    """Log columns from an `extra` document and the envelope columns already named."""
    extra = F.coalesce("extra", _empty_document())
    return conform(
        df.withColumn("source", F.lit(source))
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("fields", docs.fields_of(extra))
        .withColumn(
            "search_text",
            docs.search_text(F.col("message"), F.col("service"), F.col("host"), extra),
        )
    )


def normalize_datadog(responses: DataFrame, source: str = "datadog") -> DataFrame:
    """Entries of search responses. `tags` of the form key:value override custom attributes."""
    item = responses.select(F.explode(F.from_json("value", f"struct<{_DATADOG}>")["data"]).alias("item"))
    attrs = F.col("item.attributes")
    custom = docs.document(F.try_variant_get(attrs["attributes"], "$", "map<string,variant>"))
    pairs = F.filter(attrs["tags"], lambda t: t.contains(":"))
    tags = last_wins_entries(
        F.transform(
            pairs, lambda t: F.struct(F.split(t, ":", 2)[0].alias("key"), F.split(t, ":", 2)[1].alias("value"))
        )
    )
    named = item.select(
        attrs["timestamp"].alias("ts_raw"),
        parse_ts(attrs["timestamp"]).alias("ts"),
        F.coalesce(F.upper(attrs["status"]), F.lit(UNKNOWN_LEVEL)).alias("level"),
        F.coalesce(attrs["message"], F.lit("")).alias("message"),
        attrs["service"].alias("service"),
        attrs["host"].alias("host"),
        F.to_json("item").alias("raw"),
        custom.alias("custom"),
        docs.text_document(tags).alias("tag_doc"),
    )
    custom = F.col("custom")
    return _finish(
        named.withColumn("trace_id", docs.truthy(custom, "trace_id", "traceId")).withColumn(
            "extra", overlay(docs.without(custom, DATADOG_ENVELOPE), F.col("tag_doc"))
        ),
        source,
    )


def last_wins_entries(entries: Column) -> Column:
    """Map of an array of (key, value) in which a later entry replaces an earlier one."""

    def is_last(entry, i):
        tail = F.slice(entries, i + 2, F.size(entries))
        return ~F.exists(tail, lambda other: other["key"] == entry["key"])

    return F.map_from_entries(F.filter(entries, is_last))


def normalize_loki(responses: DataFrame, source: str = "loki") -> DataFrame:
    """Entries of stream responses. Keys of a JSON line override the stream's labels."""
    streams = responses.select(
        F.explode(F.from_json("value", f"struct<{_LOKI}>")["data"]["result"]).alias("stream")
    )
    lines = streams.select(
        last_wins(F.coalesce(F.col("stream.stream"), F.create_map().cast("map<string,string>"))).alias("labels"),
        F.explode("stream.values").alias("pair"),
    )
    parsed = lines.select(
        "labels",
        F.col("pair")[1].alias("line"),
        F.timestamp_micros(F.call_function("div", F.col("pair")[0].try_cast("bigint"), F.lit(1000))).alias("ts"),
        docs.document(docs.json_object(F.col("pair")[1])).alias("doc"),
    )
    doc, labels, line = F.col("doc"), F.col("labels"), F.col("line")

    def key(*names):
        return F.coalesce(*[docs.text_of(doc, n) for n in names])

    return _finish(
        parsed.select(
            "ts",
            iso_text(F.col("ts")).alias("ts_raw"),
            F.coalesce(F.upper(key("level", "severity")), F.lit(UNKNOWN_LEVEL)).alias("level"),
            F.coalesce(key("message", "msg"), line).alias("message"),
            F.coalesce(key("service"), labels["service"]).alias("service"),
            F.coalesce(key("host"), labels["host"]).alias("host"),
            docs.truthy(doc, "trace_id", "traceId").alias("trace_id"),
            overlay(docs.text_document(labels), docs.without(doc, LOKI_ENVELOPE)).alias("extra"),
            F.to_json(F.struct(labels.alias("stream"), line.alias("line"))).alias("raw"),
        ),
        source,
    )


def _from_message(df: DataFrame, service_without_stream: Column) -> DataFrame:
    """Level, service, trace and fields of the columns `message` and `stream`.

    A JSON message is read by key, any other JSON value says nothing, plain text is searched for
    a level word. The message text itself is kept whole.
    """
    parsed = df.withColumn("doc", docs.document(docs.json_object(F.col("message"))))
    doc, message, stream = F.col("doc"), F.col("message"), F.col("stream")
    plain_level = F.when(docs.is_json(message), F.lit(UNKNOWN_LEVEL)).otherwise(infer_level(message))
    json_level = F.coalesce(F.upper(docs.text_of(doc, "level")), F.lit(UNKNOWN_LEVEL))
    json_service = F.coalesce(docs.text_of(doc, "service"), stream, F.lit(UNKNOWN))
    return parsed.select(
        "*",
        F.when(doc.isNotNull(), json_level).otherwise(plain_level).alias("level"),
        F.when(doc.isNotNull(), json_service).otherwise(service_without_stream).alias("service"),
        stream.alias("host"),
        docs.truthy(doc, "traceId", "trace_id").alias("trace_id"),
        docs.without(doc, CLOUDWATCH_ENVELOPE).alias("extra"),
    )


def normalize_cloudwatch(responses: DataFrame, source: str = "cloudwatch") -> DataFrame:
    """Entries of query responses whose rows are lists of (field, value) cells."""
    rows = responses.select(F.explode(F.from_json("value", f"struct<{_INSIGHTS}>")["results"]).alias("cells"))
    cells = F.transform(
        "cells",
        lambda c: F.struct(c["field"].alias("key"), F.coalesce(c["value"], F.lit("")).alias("value")),
    )
    row = rows.select(last_wins_entries(cells).alias("row"))
    named = row.select(
        F.col("row")["@timestamp"].alias("ts_raw"),
        parse_ts(F.col("row")["@timestamp"]).alias("ts"),
        F.coalesce(F.col("row")["@message"], F.lit("")).alias("message"),
        F.col("row")["@logStream"].alias("stream"),
        F.to_json("row").alias("raw"),
    )
    return _finish(_from_message(named, F.col("stream")), source)


def normalize_cloudwatch_events(responses: DataFrame, source: str = "cloudwatch") -> DataFrame:
    """Entries of event responses: millisecond times, message text and log stream name."""
    event = responses.select(F.explode(F.from_json("value", f"struct<{_EVENTS}>")["events"]).alias("event"))
    ts = F.timestamp_millis(F.coalesce("event.timestamp", F.lit(0)))
    named = event.select(
        ts.alias("ts"),
        iso_text(ts).alias("ts_raw"),
        F.coalesce("event.message", F.lit("")).alias("message"),
        F.col("event.logStreamName").alias("stream"),
        F.to_json("event").alias("raw"),
    )
    nameless = F.coalesce(blank_to_null(F.col("stream")), F.lit(UNKNOWN))
    return _finish(_from_message(named, nameless), source)
