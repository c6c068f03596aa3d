"""Queries for sources and normalisers (A). Inputs are made from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import infer_level
from ..functions.timestamps import iso_text, parse_ts
from ..session import shared_dir
from .. import sources as src
from .events import iso_sql, logs, table, with_logs

# Entries per made-up response of a hosted store.
BATCH = 50

LINE_REGEX = r"(?P<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(?P<level>\w+)\] (?P<service>\w+): (?P<message>.*)"


def batch():
    return F.call_function("div", F.col("seq"), F.lit(BATCH))


def json_lines(spark, sf_dir) -> DataFrame:
    """One JSON object per log entry, numbered by `line_pos`."""
    doc = F.struct(
        F.col("ts_raw").alias("timestamp"), F.lower("level").alias("level"), "message", "service", "host",
        "trace_id", F.col("fields")["k"].cast("bigint").alias("k"),
        F.col("fields")["value"].cast("double").alias("value"), F.col("fields")["event_type"].alias("event_type"),
    )
    return logs(spark, sf_dir).select("source", F.col("seq").alias("line_pos"), F.to_json(doc).alias("value"))


def entry_columns(df: DataFrame, *more) -> DataFrame:
    return df.select(
        "seq", iso_text(F.col("ts")).alias("ts"), "level", "message", "service", "host", "trace_id", *more
    )


def field_columns():
    return [
        F.col("fields")["k"].cast("bigint").alias("k"),
        F.round(F.col("fields")["value"].cast("double"), 4).alias("value"),
        F.col("fields")["event_type"].alias("event_type"),
    ]


def document_lines(spark, sf_dir) -> DataFrame:
    """Lines of all documents, one row each."""
    line = F.explode(F.split("text", "\r\n|\r|\n"))
    return table(spark, sf_dir, "documents").select("source", line.alias("value"))


LINES_SQL = """lines as (
  select regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line
  from (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as line from documents) d)"""


def a1_read_log_lines(spark, sf_dir):
    folder = shared_dir(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(folder)
    lines = src.read_log_lines(spark, folder, "docs")
    return lines.groupBy("source", F.col("value").alias("line")).agg(F.count("*").alias("n"))


def a1_log_table(spark, sf_dir):
    """Files to table: the final `seq` is the line number over all files."""
    folder, out = shared_dir(spark, "files"), shared_dir(spark, "table")
    json_lines(spark, sf_dir).orderBy("line_pos").select("value").write.text(folder)
    lines = src.read_log_lines(spark, folder, "files")
    opts = src.LineOptions(host_field="host")
    src.write_log_table(src.parse_lines(lines, opts=opts), out)
    return entry_columns(src.read_log_table(spark, out), F.col("dt").cast("string").alias("dt"))


def a2_parse_json_lines(spark, sf_dir):
    parsed = src.parse_json_lines(json_lines(spark, sf_dir), src.LineOptions(host_field="host"))
    return entry_columns(parsed, *field_columns())


def a3_parse_regex_lines(spark, sf_dir):
    named = logs(spark, sf_dir).where(F.col("service").isNotNull())
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "level", F.lit("] "), "service", F.lit(": "), "message"
    )
    lines = named.select("source", F.col("seq").alias("line_pos"), line.alias("value"))
    parsed = src.parse_regex_lines(lines, LINE_REGEX)
    return entry_columns(parsed).drop("host", "trace_id")


def a4_plain_lines(spark, sf_dir):
    """Mixed lines: no document line is a JSON object or matches, so all end as plain entries."""
    lines = document_lines(spark, sf_dir)
    lines = lines.withColumn("value", F.trim("value")).where(F.col("value") != "")
    parsed = src.parse_lines(lines, json=True, pattern=LINE_REGEX)
    return parsed.groupBy("level", F.col("ts").isNull().alias("untimed"), "message").agg(F.count("*").alias("n"))


def a5_to_entry(spark, sf_dir):
    opts = src.LineOptions("at", "lvl", "svc", "node", "what")
    doc = F.struct(
        F.col("ts_raw").alias("at"), F.lower("level").alias("lvl"),
        F.coalesce("service", F.lit("")).alias("svc"), F.col("host").alias("node"),
        F.when(F.col("seq") % 2 == 0, F.col("message")).alias("what"),
        F.when(F.col("seq") % 2 == 1, F.concat(F.lit("msg "), "message")).alias("msg"),
        F.when(F.col("seq") % 3 > 0, F.col("trace_id")).alias("traceId"),
        F.col("fields")["k"].cast("bigint").alias("k"), F.lit(True).alias("flag"),
    )
    lines = logs(spark, sf_dir).select("source", F.col("seq").alias("line_pos"), F.to_json(doc).alias("value"))
    fields = F.col("fields")
    return entry_columns(
        src.parse_lines(lines, opts=opts),
        fields["k"].cast("bigint").alias("k"), fields["flag"].alias("flag"),
        F.array_join(F.array_sort(F.map_keys(fields)), ",").alias("keys"),
    )


def a6_parse_ts(spark, sf_dir):
    ts, case = F.col("ts"), F.col("seq") % 10
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'", "yyyy-MM-dd'T'HH:mm:ss'-0530'",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss'Z'",
    ]
    text = F.coalesce(*[F.when(case == i, F.date_format(ts, layout)) for i, layout in enumerate(layouts)])
    return logs(spark, sf_dir).select("seq", iso_text(parse_ts(text)).alias("ts"))


def _batched(df, items, name):
    """One response per BATCH entries, as JSON in `value`."""
    return df.groupBy(batch().alias("b")).agg(F.collect_list(items).alias(name))


def a7_normalize_datadog(spark, sf_dir):
    item = F.struct(
        F.col("seq").cast("string").alias("id"), F.lit("log").alias("type"),
        F.struct(
            F.col("ts_raw").alias("timestamp"), F.lower("level").alias("status"), "message", "service", "host",
            F.struct(
                F.col("fields")["k"].cast("bigint").alias("k"), F.lit("old").alias("team"),
                "trace_id", F.col("seq").alias("id"),
            ).alias("attributes"),
            F.array(F.concat(F.lit("team:a:"), "source"), F.lit("loose")).alias("tags"),
        ).alias("attributes"),
    )
    responses = _batched(logs(spark, sf_dir), item, "data").select(F.to_json(F.struct("data")).alias("value"))
    fields = F.col("fields")
    found = src.normalize_datadog(responses).withColumn("seq", fields["id"].cast("bigint"))
    return entry_columns(found, fields["k"].cast("bigint").alias("k"), fields["team"].alias("team"))


def a8_normalize_loki(spark, sf_dir):
    entries = logs(spark, sf_dir)
    is_json = F.col("seq") % 2 == 0
    inner = F.to_json(
        F.struct(
            F.col("message").alias("msg"), F.lower("level").alias("severity"), "trace_id",
            F.col("seq").alias("id"), F.lit("json").alias("shape"),
        )
    )
    line = F.when(is_json, inner).otherwise(F.concat_ws(" ", "seq", "message"))
    labels = F.map_filter(
        F.create_map(F.lit("service"), "service", F.lit("host"), "host", F.lit("shape"), F.lit("text")),
        lambda _, v: v.isNotNull(),
    )
    ns = (F.unix_micros("ts") * 1000).cast("string")
    streams = (
        entries.select(batch().alias("b"), "service", "host", labels.alias("stream"), F.array(ns, line).alias("pair"))
        .groupBy("b", "service", "host")
        .agg(F.first("stream").alias("stream"), F.collect_list("pair").alias("values"))
    )
    result = streams.groupBy("b").agg(F.collect_list(F.struct("stream", "values")).alias("result"))
    data = F.struct(F.lit("streams").alias("resultType"), "result").alias("data")
    responses = result.select(F.to_json(F.struct(data)).alias("value"))
    found = src.normalize_loki(responses)
    number = F.coalesce(F.col("fields")["id"], F.regexp_extract("message", "^(\\d+) ", 1)).cast("bigint")
    return entry_columns(found.withColumn("seq", number), F.col("fields")["shape"].alias("shape"))


def _cloud_message():
    """JSON for two of three entries, of them every other without a service; else plain text."""
    service = F.when(F.col("seq") % 2 == 0, F.col("service"))
    doc = F.to_json(
        F.struct("message", F.lower("level").alias("level"), service.alias("service"),
                 F.col("trace_id").alias("traceId"), F.col("fields")["k"].alias("k"))
    )
    return F.when(F.col("seq") % 3 > 0, doc).otherwise(F.concat("level", F.lit(" "), "message"))


CLOUD_SQL = """
  case when seq % 3 > 0 then level when level = 'WARNING' then 'WARN' else level end as level,
  case when seq % 3 > 0 and seq % 2 = 0 and service is not null then service else host end as service,
  host, case when seq % 3 > 0 then trace_id end as trace_id,
  case when seq % 3 > 0 then k end as k,
  case when seq % 3 > 0 then message else level || ' ' || message end as text
  from logs"""


def _cloud_columns(found):
    """The message is kept whole; its JSON text is read back for the comparison."""
    text = F.coalesce(F.get_json_object("message", "$.message"), F.col("message"))
    return found.select(
        iso_text(F.col("ts")).alias("ts"), "level", "service", "host", "trace_id",
        F.col("fields")["k"].cast("bigint").alias("k"), text.alias("text"),
    )


def a9_normalize_cloudwatch(spark, sf_dir):
    def cell(field, value):
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    cells = F.array(cell("@timestamp", ts), cell("@message", _cloud_message()), cell("@logStream", F.col("host")))
    responses = _batched(logs(spark, sf_dir), cells, "results").select(F.to_json(F.struct("results")).alias("value"))
    return _cloud_columns(src.normalize_cloudwatch(responses))


def a10_infer_level(spark, sf_dir):
    shape = F.col("seq") % 4
    line = (
        F.when(shape == 0, F.concat(F.lower("level"), F.lit(": "), "message"))
        .when(shape == 1, F.concat("message", F.lit(" "), "level", F.lit(" "), "host"))
        .when(shape == 2, F.concat(F.lit("["), "level", F.lit("] "), "message"))
        .otherwise(F.col("message"))
    )
    return logs(spark, sf_dir).select("seq", infer_level(line).alias("level"))


def a11_normalize_cloudwatch_events(spark, sf_dir):
    event = F.struct(
        F.unix_millis("ts").alias("timestamp"), _cloud_message().alias("message"), F.col("host").alias("logStreamName")
    )
    responses = _batched(logs(spark, sf_dir), event, "events").select(F.to_json(F.struct("events")).alias("value"))
    return _cloud_columns(src.normalize_cloudwatch_events(responses))


def hourly(spark, sf_dir):
    return (
        logs(spark, sf_dir)
        .groupBy("source", F.date_trunc("HOUR", "ts").alias("hour"))
        .agg(F.count("*").alias("n"), F.max(F.col("fields")["value"].cast("double")).alias("peak"))
        .withColumn("hour", iso_text(F.col("hour")))
    )


HOURLY_SQL = f"""hourly as (
  select source, {iso_sql('hour')} as hour, n, peak
  from (select source, date_trunc('hour', ts) as hour, count(*) as n, max(value) as peak from logs group by 1, 2) h)"""


def _bucket_columns(buckets, *keys):
    return buckets.select(
        *[F.col("key")[k].alias(n) for k, n in keys], F.round("value", 4).alias("value"), "count"
    )


def a12_buckets_datadog(spark, sf_dir):
    item = F.struct(
        F.struct("source", "hour").alias("by"),
        F.array(
            F.struct(F.lit("n/a").alias("value")), F.struct(F.col("n").cast("string").alias("value")),
        ).alias("aggregations"),
    )
    rows = hourly(spark, sf_dir).groupBy(F.substring("hour", 1, 10).alias("day")).agg(F.collect_list(item).alias("buckets"))
    responses = rows.select(F.to_json(F.struct(F.struct("buckets").alias("data"))).alias("value"))
    return _bucket_columns(src.normalize_buckets(responses, "datadog"), ("source", "source"), ("hour", "hour"))


def a12_buckets_loki_vector(spark, sf_dir):
    item = F.struct(
        F.struct("source", "hour").alias("metric"), F.array(F.lit("0"), F.col("peak").cast("string")).alias("value")
    )
    rows = hourly(spark, sf_dir).groupBy(F.substring("hour", 1, 10).alias("day")).agg(F.collect_list(item).alias("result"))
    data = F.struct(F.lit("vector").alias("resultType"), "result").alias("data")
    responses = rows.select(F.to_json(F.struct(data)).alias("value"))
    return _bucket_columns(src.normalize_buckets(responses, "loki"), ("source", "source"), ("hour", "hour"))


def a12_buckets_loki_matrix(spark, sf_dir):
    days = (
        hourly(spark, sf_dir)
        .groupBy("source", F.substring("hour", 1, 10).alias("day"))
        .agg(F.collect_list(F.array("hour", F.col("n").cast("string"))).alias("values"))
    )
    item = F.struct(F.struct("source", "day").alias("metric"), "values")
    rows = days.groupBy("day").agg(F.collect_list(item).alias("result"))
    data = F.struct(F.lit("matrix").alias("resultType"), "result").alias("data")
    responses = rows.select(F.to_json(F.struct(data)).alias("value"))
    return _bucket_columns(src.normalize_buckets(responses, "loki"), ("source", "source"), ("day", "day"))


def a12_buckets_insights(spark, sf_dir):
    def cell(field, value):
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))

    cells = F.array(cell("bin(1h)", F.col("hour")), cell("@logStream", F.col("source")), cell("count()", F.col("n")))
    rows = hourly(spark, sf_dir).groupBy(F.substring("hour", 1, 10).alias("day")).agg(F.collect_list(cells).alias("results"))
    responses = rows.select(F.to_json(F.struct("results")).alias("value"))
    return _bucket_columns(src.normalize_buckets(responses, "insights"), ("@logStream", "source"), ("bin(1h)", "hour"))


def a13_union_sources(spark, sf_dir):
    entries = logs(spark, sf_dir)
    frames = {f"src{i}": entries.where(F.col("source") == f"src{i}") for i in range(3)}
    frames["gone"] = None
    whole = src.union_sources(frames, skip_missing=True)
    return whole.groupBy("source", "level").agg(F.count("*").alias("n"))


def a14_list_sources(spark, sf_dir):
    found = src.list_sources(logs(spark, sf_dir))
    return found.select("source", "entries", iso_text(F.col("first_ts")).alias("first_ts"),
                        iso_text(F.col("last_ts")).alias("last_ts"))


def a4_mixed_lines(spark, sf_dir):
    """One source of JSON, regex, JSON array, broken JSON and blank lines in turn, read from files."""
    folder = shared_dir(spark, "lines")
    doc = F.struct(F.col("ts_raw").alias("timestamp"), F.lower("level").alias("level"), "message", "service")
    fitting = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "level", F.lit("] "),
        F.coalesce("service", F.lit("none")), F.lit(": "), "message",
    )
    kind = F.col("seq") % 5
    line = (
        F.when(kind == 0, F.to_json(doc)).when(kind == 1, fitting)
        .when(kind == 2, F.concat(F.lit('["'), "message", F.lit('"]')))
        .when(kind == 3, F.concat(F.lit('{"message": "'), "message"))
        .otherwise(F.lit("  "))
    )
    logs(spark, sf_dir).select(line.alias("value")).write.text(folder)
    found = src.parse_lines(src.read_log_lines(spark, f"{folder}/part-*", "mixed"), pattern=LINE_REGEX)
    return found.groupBy("level", "service", "message", F.col("ts").isNull().alias("untimed")).agg(
        F.count("*").alias("n")
    )


def a15_source_health(spark, sf_dir):
    configured = ["src0", "src1", "src2", "src9"]
    found = src.source_health(logs(spark, sf_dir), configured, [*configured, "other"])
    return found.select("source", "status", "entries", F.round("untimed_share", 4).alias("untimed_share"),
                        iso_text(F.col("newest_ts")).alias("newest_ts"))


def a16_describe_schema(spark, sf_dir):
    return src.describe_schema(logs(spark, sf_dir), "src1")


def a15_source_health_files(spark, sf_dir):
    """Two sources of landed files: one of all document lines, one of a blank file and an empty folder."""
    full, blank = shared_dir(spark, "lines"), shared_dir(spark, "lines")
    documents = table(spark, sf_dir, "documents")
    documents.select("text").write.text(full)
    documents.groupBy().agg(F.lit(" ").alias("value")).write.text(blank)
    paths = {"docs": f"{full}/part-*", "blank": f"{blank}/part-*", "none": f"{blank}/nothing-*"}
    files = src.union_sources({s: src.log_files(spark, p, s) for s, p in paths.items()})
    entries = src.union_sources({s: src.plain_lines(src.read_log_lines(spark, p, s)) for s, p in paths.items()})
    found = src.source_health(entries, list(paths), [*paths, "other"], files)
    return found.select("source", "status", "entries", "unreadable")


def a16_known_formats(spark, sf_dir):
    return src.known_formats(src.parse_json_lines(json_lines(spark, sf_dir)), "src1")


def a16_sample_entry(spark, sf_dir):
    return entry_columns(src.sample_entry(logs(spark, sf_dir), "src1"), *field_columns())


ISO = iso_sql("ts")
ENTRY_SQL = f"seq, {ISO} as ts, level, message, service, host, trace_id"
FIELD_SQL = "k, round(value, 4) as value, event_type"

_TO_SECOND = "date_trunc('second', ts)"
_TO_MILLI = "date_trunc('millisecond', ts)"

QUERIES = {
    "a1_read_log_lines": (a1_read_log_lines, "with " + LINES_SQL + """
        select 'docs' as source, line, count(*) as n from lines where line <> '' group by line"""),
    "a1_log_table": (a1_log_table, with_logs(
        f"select {ENTRY_SQL}, strftime(ts, '%Y-%m-%d') as dt from logs")),
    "a2_parse_json_lines": (a2_parse_json_lines, with_logs(f"select {ENTRY_SQL}, {FIELD_SQL} from logs")),
    "a3_parse_regex_lines": (a3_parse_regex_lines, with_logs(f"""
        select seq, {iso_sql(_TO_SECOND)} as ts, level, message, service from logs where service is not null""")),
    "a4_plain_lines": (a4_plain_lines, "with " + LINES_SQL + """
        select 'UNKNOWN' as level, true as untimed, line as message, count(*) as n
        from lines where line <> '' group by line"""),
    "a4_mixed_lines": (a4_mixed_lines, with_logs("""
        select level, service, message, untimed, count(*) as n from (
          select level, service, message, false as untimed from logs where seq % 5 = 0
          union all select level, coalesce(service, 'none'), message, false from logs where seq % 5 = 1
          union all select 'UNKNOWN', null, '["' || message || '"]', true from logs where seq % 5 = 2
          union all select 'UNKNOWN', null, '{"message": "' || message, true from logs where seq % 5 = 3) m
        group by all""")),
    "a5_to_entry": (a5_to_entry, with_logs(f"""
        select seq, {ISO} as ts, level, case when seq % 2 = 0 then message else 'msg ' || message end as message,
          service, host, case when seq % 3 > 0 then trace_id end as trace_id, k, 'true' as flag,
          case when seq % 2 = 0 then 'flag,k' else 'flag,k,msg' end as keys
        from logs""")),
    "a6_parse_ts": (a6_parse_ts, with_logs(f"""
        select seq, {iso_sql('t')} as ts from (
          select seq, case when seq % 10 = 0 then ts - interval 2 hour
            when seq % 10 = 1 then {_TO_SECOND} + interval 330 minute
            when seq % 10 in (2, 4, 6) then ts when seq % 10 in (3, 5, 7) then {_TO_SECOND} end as t
          from logs) x""")),
    "a7_normalize_datadog": (a7_normalize_datadog, with_logs(f"""
        select {ENTRY_SQL}, k, 'a:' || source as team from logs""")),
    "a8_normalize_loki": (a8_normalize_loki, with_logs(f"""
        select seq, {ISO} as ts, case when seq % 2 = 0 then level else 'UNKNOWN' end as level,
          case when seq % 2 = 0 then message else seq || ' ' || message end as message, service, host,
          case when seq % 2 = 0 then trace_id end as trace_id,
          case when seq % 2 = 0 then 'json' else 'text' end as shape
        from logs""")),
    "a9_normalize_cloudwatch": (a9_normalize_cloudwatch, with_logs(
        f"select {iso_sql(_TO_MILLI)} as ts, {CLOUD_SQL}")),
    "a10_infer_level": (a10_infer_level, with_logs("""
        select seq, case when seq % 4 in (2, 3) then 'UNKNOWN' when level = 'WARNING' and seq % 4 = 1 then 'WARN'
          when level = 'WARNING' then 'WARN' else level end as level from logs""")),
    "a11_normalize_cloudwatch_events": (a11_normalize_cloudwatch_events, with_logs(
        f"select {iso_sql(_TO_MILLI)} as ts, {CLOUD_SQL}")),
    "a12_buckets_datadog": (a12_buckets_datadog, with_logs(
        "select source, hour, cast(n as double) as value, n as count from hourly", HOURLY_SQL)),
    "a12_buckets_loki_vector": (a12_buckets_loki_vector, with_logs("""
        select source, hour, round(peak, 4) as value,
          case when peak = floor(peak) then cast(peak as bigint) else 1 end as count from hourly""", HOURLY_SQL)),
    "a12_buckets_loki_matrix": (a12_buckets_loki_matrix, with_logs("""
        select source, hour[1:10] as day, cast(sum(n) as double) as value, count(*) as count
        from hourly group by 1, 2""", HOURLY_SQL)),
    "a12_buckets_insights": (a12_buckets_insights, with_logs(
        "select source, hour, cast(n as double) as value, n as count from hourly", HOURLY_SQL)),
    "a13_union_sources": (a13_union_sources, with_logs(
        "select source, level, count(*) as n from logs group by 1, 2")),
    "a14_list_sources": (a14_list_sources, with_logs(f"""
        select source, count(*) as entries, {iso_sql('min(ts)')} as first_ts, {iso_sql('max(ts)')} as last_ts
        from logs group by source""")),
    "a15_source_health": (a15_source_health, with_logs(f"""
        select w.source, case when w.source = 'other' then 'unknown' when max(l.ts) is null then 'degraded'
            else 'healthy' end as status, count(l.ts) as entries,
          case when count(l.ts) > 0 then 0.0::double end as untimed_share, {iso_sql('max(l.ts)')} as newest_ts
        from (values ('src0'), ('src1'), ('src2'), ('src9'), ('other')) w(source)
        left join logs l on l.source = w.source group by w.source""")),
    "a16_describe_schema": (a16_describe_schema, with_logs("""
        select 'timestamp' as name, 'timestamp' as type, true as required, cast(null as bigint) as entries
        union all select 'level', 'string', true, null union all select 'message', 'string', true, null
        union all select 'service', 'string', false, null union all select 'host', 'string', false, null
        union all select 'k', 'number', false, count(k) from logs where source = 'src1'
        union all select 'value', 'number', false, count(value) from logs where source = 'src1'
        union all select 'event_type', 'string', false, count(event_type) from logs where source = 'src1'""")),
    "a15_source_health_files": (a15_source_health_files, "with " + LINES_SQL + """
        select 'docs' as source, 'healthy' as status, count(*) as entries, 0::bigint as unreadable from lines where line <> ''
        union all select 'blank', 'healthy', 0, 0 union all select 'none', 'degraded', 0, 0
        union all select 'other', 'unknown', 0, null"""),
    "a16_known_formats": (a16_known_formats, with_logs("""
        select 'json' as format, count(*) as entries from logs where source = 'src1' union all select 'regex', 0""")),
    "a16_sample_entry": (a16_sample_entry, with_logs(f"""
        select {ENTRY_SQL}, {FIELD_SQL} from (select * from logs where source = 'src1' order by seq limit 1) l""")),
}
