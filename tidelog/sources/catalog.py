"""What is in the log table: sources, their health, their keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.values import bind, last_wins, number
from .documents import json_object

# Envelope fields each kind of source always declares (name, type, required).
ENVELOPES = {
    "local": (
        ("timestamp", "timestamp", True),
        ("level", "string", True),
        ("message", "string", True),
        ("service", "string", False),
        ("host", "string", False),
    ),
    "datadog": (
        ("timestamp", "timestamp", True),
        ("status", "string", True),
        ("message", "string", True),
        ("service", "string", False),
        ("host", "string", False),
        ("tags", "array", False),
    ),
    "loki": (
        ("timestamp", "timestamp", True),
        ("message", "string", True),
        ("level", "string", False),
        ("service", "string", False),
        ("host", "string", False),
    ),
    "cloudwatch": (
        ("@timestamp", "timestamp", True),
        ("@message", "string", True),
        ("@logStream", "string", False),
        ("@logGroup", "string", False),
    ),
}

# Line formats each kind of source is known to hold.
KNOWN_FORMATS = {
    "local": ("json", "regex"),
    "datadog": ("json",),
    "loki": ("json", "logfmt"),
    "cloudwatch": ("json", "plaintext"),
}


def union_sources(frames: dict, skip_missing: bool = False) -> DataFrame:
    """All entries of several sources, each under its id.

    A value may be a DataFrame, a function that makes one, or None for a source that is not
    there. With `skip_missing` a source that is absent or cannot be opened is left out.
    """
    whole = None
    for source, frame in frames.items():
        try:
            frame = frame() if callable(frame) else frame
            if frame is None:
                raise KeyError(f"unknown source: {source}")
        except Exception:
            if skip_missing:
                continue
            raise
        frame = frame.withColumn("source", F.lit(source))
        whole = frame if whole is None else whole.unionByName(frame, allowMissingColumns=True)
    if whole is None:
        raise KeyError("no source could be opened")
    return whole


def choose_sources(logs: DataFrame, sources=None) -> DataFrame:
    return logs.where(F.col("source").isin(*sources)) if sources else logs


def list_sources(logs: DataFrame) -> DataFrame:
    """Source ids with their number of entries and time span."""
    return logs.groupBy("source").agg(
        F.count("*").alias("entries"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def source_health(logs: DataFrame, configured, asked=None, files: DataFrame | None = None) -> DataFrame:
    """Freshness per source: healthy with entries, degraded without, unknown if not configured.

    `files` counts distinct files where the frame still knows them, in two steps so that one
    source with most of the rows is pre-aggregated. Given the `log_files` of the sources, a source is healthy if it
    has files and all could be read, blank ones too, and `unreadable` counts the others.
    """
    spark = logs.sparkSession
    ids = [(s, s in set(configured)) for s in (asked if asked is not None else configured)]
    wanted = spark.createDataFrame(ids, "source string, configured boolean")
    has_files = "file_path" in logs.columns
    keys = ["source"] + (["file_path"] if has_files else [])
    per_file = logs.groupBy(*keys).agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("ts").isNull()).alias("untimed"),
        F.max("ts").alias("newest_ts"),
    )
    named = F.count("file_path") if has_files else F.lit(None).cast("bigint")
    profile = per_file.groupBy("source").agg(
        named.alias("files"),
        F.sum("entries").alias("entries"),
        F.sum("untimed").alias("untimed"),
        F.max("newest_ts").alias("newest_ts"),
    )
    entries = F.coalesce("entries", F.lit(0))
    status = (
        F.when(~F.col("configured"), "unknown").when(entries > 0, "healthy").otherwise("degraded")
    )
    known = F.col("configured")
    if files is not None:
        listed = files.groupBy("source").agg(
            F.count("*").alias("listed"), F.count_if(~F.col("readable")).alias("unreadable")
        )
        profile = profile.join(listed, "source", "full").withColumn("files", F.coalesce("listed", F.lit(0)))
        whole = (F.col("files") > 0) & (F.col("unreadable") == 0)
        status = F.when(~known, "unknown").when(whole, "healthy").otherwise("degraded")
    return wanted.join(profile, "source", "left").select(
        "source",
        status.alias("status"),
        F.when(known, F.col("files")).alias("files"),
        F.when(known, entries).otherwise(F.lit(0)).alias("entries"),
        F.when(known, F.col("untimed") / F.col("entries")).alias("untimed_share"),
        F.when(known, F.col("newest_ts")).alias("newest_ts"),
        *([] if files is None else [F.when(known, F.coalesce("unreadable", F.lit(0))).alias("unreadable")]),
    )


def _text_type(all_numbers: Column, all_booleans: Column) -> Column:
    return F.when(all_booleans, "boolean").when(all_numbers, "number").otherwise("string")


def _json_kind(value: Column) -> Column:
    """Kind of a variant: string, object, array, or null for what its text tells as well."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
    )


def describe_schema(logs: DataFrame, source: str | None = None, kind: str = "local") -> DataFrame:
    """Declared envelope fields, then the keys found in `fields` with type and coverage.

    A key whose values are all JSON strings, arrays or objects in the lines as read has that type. Else the texts
    tell: all numbers, all booleans, or strings.
    """
    spark = logs.sparkSession
    declared = spark.createDataFrame(
        [(n, t, r) for n, t, r in ENVELOPES[kind]], "name string, type string, required boolean"
    ).withColumn("entries", F.lit(None).cast("bigint"))
    entries = logs if source is None else logs.where(F.col("source") == source)
    read = json_object(F.col("raw")) if "raw" in logs.columns else F.lit(None).cast("map<string,variant>")

    def typed(values):
        return F.transform(
            F.map_entries("fields"),
            lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text"), _json_kind(values[e["key"]]).alias("kind")),
        )

    values = F.coalesce(bind(read, last_wins), F.create_map().cast("map<string,variant>"))
    pairs = entries.select(F.explode(bind(values, typed)).alias("pair")).select("pair.*")
    found = pairs.groupBy("name").agg(
        F.count("*").alias("entries"),
        F.count("kind").alias("kinds"),
        F.min("kind").alias("lowest"),
        F.max("kind").alias("highest"),
        F.min(number(F.col("text")).isNotNull()).alias("all_numbers"),
        F.min(F.lower("text").isin("true", "false")).alias("all_booleans"),
    )
    taken = [n for n, _, _ in ENVELOPES[kind]]
    alike = (F.col("kinds") == F.col("entries")) & (F.col("lowest") == F.col("highest"))
    found = found.where(~F.col("name").isin(*taken)).select(
        "name",
        F.when(alike, F.col("lowest")).otherwise(_text_type(F.col("all_numbers"), F.col("all_booleans"))).alias("type"),
        F.lit(False).alias("required"),
        "entries",
    )
    return declared.unionByName(found)


def _paths(path: str, kind: T.DataType):
    """(path, type) of a type and all that it holds; the elements of an array have its path and `[]`."""
    if isinstance(kind, T.StructType):
        if path:
            yield path, "object"
        for field in kind.fields:
            yield from _paths(f"{path}.{field.name}" if path else field.name, field.dataType)
    elif isinstance(kind, T.ArrayType):
        yield path, "array"
        yield from _paths(f"{path}[]", kind.elementType)
    elif isinstance(kind, T.NullType):
        yield path, "null"
    elif isinstance(kind, T.VariantType):
        yield path, "mixed"
    elif isinstance(kind, T.StringType):
        yield path, "string"
    elif isinstance(kind, T.BooleanType):
        yield path, "boolean"
    else:
        yield path, "number"


def nested_keys(logs: DataFrame, source: str | None = None) -> DataFrame:
    """(source, path, type) of all keys of the JSON lines as read, at any depth, as `a.b.c`; `a[]` are an array's elements.

    The types of all lines are merged inside tasks and per source: `mixed` where lines differ, `null` where nothing else
    was seen. A source comes back as one text, as long as its lines have distinct keys. Lines that are no JSON object
    have none.
    """
    spark = logs.sparkSession
    entries = logs if source is None else logs.where(F.col("source") == source)
    value = F.when(json_object(F.col("raw")).isNotNull(), F.try_parse_json("raw"))
    found = entries.select("source", value.alias("value")).where(F.col("value").isNotNull())
    kinds = found.groupBy("source").agg(F.schema_of_variant_agg("value").alias("kind")).collect()
    rows = []
    for row in kinds:
        ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], row["kind"])
        rows += [(row["source"], *found) for found in _paths("", T._parse_datatype_string(ddl))]
    return spark.createDataFrame(rows, "source string, path string, type string")


def known_formats(logs: DataFrame, source: str | None = None, kind: str = "local") -> DataFrame:
    """The line formats a kind of source is known to hold, each with the number of entries read in it.

    Entries whose line is a JSON object count for `json`, other parsed lines for the second format of the kind.
    """
    spark = logs.sparkSession
    formats = spark.createDataFrame([(f,) for f in KNOWN_FORMATS[kind]], "format string")
    entries = logs if source is None else logs.where(F.col("source") == source)
    other = F.lit(KNOWN_FORMATS[kind][-1])
    of = F.when(json_object(F.col("raw")).isNotNull(), "json").otherwise(other)
    seen = entries.where(F.col("raw").isNotNull()).groupBy(of.alias("format")).agg(F.count("*").alias("entries"))
    return formats.join(seen, "format", "left").select("format", F.coalesce("entries", F.lit(0)).alias("entries"))


def sample_entry(logs: DataFrame, source: str | None = None) -> DataFrame:
    """One entry of the source, the first in ingest order."""
    entries = logs if source is None else logs.where(F.col("source") == source)
    return entries.orderBy("seq").limit(1)
