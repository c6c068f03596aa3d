"""Queries for predicates (B), order (C), aggregation (D) and question tags (I)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.timeexpr import TimeRange
from ..functions.timestamps import iso_text
from ..operators import aggregate as agg
from ..operators import ordering as order
from ..operators import predicates as pred
from ..operators import questions
from ..operators import summary
from .events import iso_sql, logs, table, with_logs
from .source_queries import ENTRY_SQL, entry_columns

REFERENCE = datetime(2024, 1, 31, tzinfo=timezone.utc)
RANGE = TimeRange.of("2024-01-05T00:00:00Z", "2024-01-20t12:00:00z")
RANGE_SQL = "ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'"
RECENT = TimeRange.of("now-10d12h30m", "now-1.5d", REFERENCE)
RECENT_SQL = "ts between timestamp '2024-01-20 11:30:00' and timestamp '2024-01-29 12:00:00'"


def bucket_text():
    return iso_text(F.col("timestamp_bucket")).alias("timestamp_bucket")


def rows(operator):
    """A query that shows the entries an operator keeps."""
    return lambda spark, sf_dir: entry_columns(operator(logs(spark, sf_dir)))


def rows_sql(condition, tail=""):
    return with_logs(f"select {ENTRY_SQL} from (select * from logs where {condition} {tail}) l")


# Added before rounding, on both sides: averages that end in a 5 right behind the last kept digit
# would else round by their last bit, which depends on the order of summation.
NUDGE = 1e-9


def rounded(df, *names):
    return df.select(
        *[F.round(F.col(c) + NUDGE, 4).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def r4(value):
    return f"round({value} + {NUDGE}, 4)"


def d1_d4_errors_per_service_hour(spark, sf_dir):
    errors = pred.filter_logs(logs(spark, sf_dir), level="error", tr=RANGE)
    found = agg.aggregate(errors, ["service"], bucket="1h")
    return found.select("service", bucket_text(), "value", "count")


def d1_count(spark, sf_dir):
    return agg.aggregate(logs(spark, sf_dir), ["level", "service", "event_type"], "unheard of", tr=RANGE)


def d1_count_all(spark, sf_dir):
    return agg.aggregate(logs(spark, sf_dir), tr=RANGE)


def numeric(metric, name):
    def query(spark, sf_dir):
        found = agg.aggregate(logs(spark, sf_dir), ["service", "level"], metric, name, tr=RANGE)
        return rounded(found, "value")

    return query


def numeric_sql(fold):
    return with_logs(f"""
        select coalesce(service, 'unknown') as service, level, {r4(fold)} as value, count(*) as count
        from logs where {RANGE_SQL} group by 1, 2""")


def d3_keys(spark, sf_dir):
    keys = ["host", "service", "source", "k", "nothing"]
    return agg.aggregate(logs(spark, sf_dir), keys).drop("value")


def bucketed(spec):
    def query(spark, sf_dir):
        return agg.aggregate(logs(spark, sf_dir), ["level"], bucket=spec).select("level", bucket_text(), "value", "count")

    return query


def bucketed_sql(start):
    return with_logs(f"""
        select level, {iso_sql('start')} as timestamp_bucket, cast(count(*) as double) as value, count(*) as count
        from (select *, {start} as start from logs) l group by level, start""")


def d5_epoch_bucket(spark, sf_dir):
    found = agg.count_by_epoch(logs(spark, sf_dir), "7m", ["source"])
    return found.select(bucket_text(), "source", "count")


def over(func, by, field=None):
    def query(spark, sf_dir):
        found = agg.over_time(logs(spark, sf_dir), func, "6h", by, field)
        return rounded(found.select(bucket_text(), *by, "value"), "value")

    return query


def over_sql(fold):
    return with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, level, {r4('sum(v)')} as value from (
          select time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as start, source, level, service, host,
            {fold} as v from logs group by all) s
        group by start, level""")


def d7_stats_by(spark, sf_dir):
    found = agg.stats_by(logs(spark, sf_dir), "avg", ["service", "level"], "value", limit=20)
    return rounded(found, "value")


def d7_stats_by_bins(spark, sf_dir):
    return agg.stats_by(logs(spark, sf_dir), "sum").select(bucket_text(), "value")


def d8_facet_counts(spark, sf_dir):
    found = agg.facet_counts(logs(spark, sf_dir), ["host", "level", "k"], "max", "value", 4)
    return rounded(found, "value")


def d8_facet_counts_by_time(spark, sf_dir):
    found = agg.facet_counts(logs(spark, sf_dir), limit=25)
    return found.select(iso_text(F.col("timestamp").cast("timestamp")).alias("timestamp"), "value", "count")


def d10_summarize(spark, sf_dir):
    found = summary.summarize(logs(spark, sf_dir), "code 1")
    spelled = {
        name: F.array_join(
            F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias(name)
        for name in ("levels", "services")
    }
    top = F.array_join("top_messages", "|").alias("top_messages")
    return found.select("count", spelled["levels"], spelled["services"], top, "summary")


def d10_histograms(spark, sf_dir):
    return summary.histograms(logs(spark, sf_dir))


D10_SQL = with_logs("""
  select (select count(*) from hits) as count,
    (select string_agg(level || '=' || n, ',' order by level) from lv) as levels,
    (select string_agg(service || '=' || n, ',' order by service) from sv) as services,
    (select string_agg(message, '|' order by n desc, message) from ms) as top_messages,
    'Analyzed ' || (select count(*) from hits) || ' log entries. Levels — '
      || (select string_agg(level || ': ' || n, ', ' order by level) from lv) || '. Services — '
      || (select string_agg(service || ': ' || n, ', ' order by service) from sv) || '. Top message: '''
      || (select first(message order by n desc, message) from ms) || ''' ('
      || (select max(n) from ms) || ' occurrences).' as summary""",
  """hits as (select *, coalesce(service, 'unknown') as svc from logs
       where lower(concat_ws('|', message, service, host, event_type)) like '%code 1%' or lower(level) = 'code 1')""",
  "lv as (select level, count(*) as n from hits group by 1)",
  "sv as (select svc as service, count(*) as n from hits group by 1)",
  "ms as (select message, count(*) as n from hits group by 1 order by n desc, message limit 5)")


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def tagged(**tags):
    def query(spark, sf_dir):
        text = F.col("text")
        return conversations(spark, sf_dir).select("conv_id", "turn", *[f(text).alias(n) for n, f in tags.items()])

    return query


def generated(spark, sf_dir):
    """Questions made from log entries: level word, service or host phrase and time phrase."""
    n = F.col("seq")
    service = (
        F.when(n % 4 == 0, F.concat(F.lit(" from service "), "service"))
        .when(n % 4 == 1, F.concat(F.lit(" Service:"), "service", F.lit(" host: "), "host"))
        .when(n % 4 == 2, F.concat(F.lit(" IN service  "), "service"))
        .otherwise(F.concat(F.lit(" host:"), "host"))
    )
    phrases = [p for _, group in questions.RANGE_PHRASES for p in group] + ["lately"]
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (n % len(phrases) + 1).cast("int"))
    text = F.concat_ws("", F.lit("Show me "), "level", F.lit(" logs about "), "message", service, F.lit(" in the "), phrase)
    return logs(spark, sf_dir).select("seq", text.alias("text"))


PHRASES = [p for _, group in questions.RANGE_PHRASES for p in group] + ["lately"]


def phrase_case(text):
    whens = " ".join(
        "when " + " or ".join(f"contains({text}, '{p}')" for p in group) + f" then '{span}'"
        for span, group in questions.RANGE_PHRASES
    )
    return f"case {whens} else '{questions.DEFAULT_RANGE}' end"


GENERATED_SQL = f"""asked as (
  select seq, 'Show me ' || level || ' logs about ' || message || coalesce(case seq % 4
      when 0 then ' from service ' || service when 1 then ' Service:' || service || ' host: ' || host
      when 2 then ' IN service  ' || service else ' host:' || host end, '') || ' in the '
      || ({PHRASES!r})[seq % {len(PHRASES)} + 1] as text
  from logs)"""


def word_after(text, prefixes):
    whens = " ".join(
        f"when contains({text}, '{p}') then nullif(regexp_extract({text}, '{p}\\s*(\\S+)', 1), '')" for p in prefixes
    )
    return f"case {whens} end"


def level_case(text):
    whens = " ".join(f"when contains({text}, '{w}') then '{w}'" for w in questions.LEVELS)
    return f"case {whens} end"


KEYWORD_SQL = (
    "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 3 and "
    f"not list_contains({questions.STOP_WORDS!r}, lower(w)))[1]"
)


def i_tag_questions(spark, sf_dir):
    return questions.tag_questions(generated(spark, sf_dir)).drop("text")


ISO = iso_sql("ts")

QUERIES = {
    "b1_search": (rows(lambda df: pred.search(df, "TIMEOUT", RANGE)), rows_sql(
        f"{RANGE_SQL} and (contains(lower(concat_ws('|', message, service, host, event_type)), 'timeout') or lower(level) = 'timeout')")),
    "b1_search_level": (rows(lambda df: pred.search(df, "warn")), rows_sql("level = 'WARN'")),
    "b1_search_field": (rows(lambda df: pred.search(df, "Purch")), rows_sql(
        "contains(lower(concat_ws('|', message, service, host, event_type)), 'purch')")),
    "b2_filter_logs": (
        rows(lambda df: pred.filter_logs(df, "error", "svc1", custom_fields={"event_type": "error", "k": 7})),
        rows_sql("level = 'ERROR' and service = 'svc1' and event_type = 'error' and k = 7")),
    "b2_filter_logs_trace": (
        rows(lambda df: pred.filter_logs(df, trace_id="trace-17")),
        rows_sql("trace_id = 'trace-17'")),
    "b3_in_time_range": (rows(lambda df: pred.in_time_range(df, RECENT)), rows_sql(RECENT_SQL)),
    "b4_line_contains": (rows(lambda df: pred.line_contains(df, "refused code 1")), rows_sql(
        "contains(message, 'refused code 1')")),
    "b5_match_labels": (
        rows(lambda df: pred.match_labels(df, {"level": "Warning", "host": "host2"}, {"source": "src0"}, {"k": "11"})),
        rows_sql("level = 'WARNING' and host = 'host2' and k = 11")),
    "b5_match_labels_defaults": (
        rows(lambda df: pred.match_labels(df, None, {"source": "src0", "event_type": "view"})),
        rows_sql("source = 'src0' and event_type = 'view'")),
    "b6_line_matches": (rows(lambda df: pred.line_matches(df, r"code 1\d$")), rows_sql(
        r"regexp_matches(message, 'code 1\d$')")),
    "b7_filter_stream": (
        rows(lambda df: pred.filter_stream(
            df.withColumn("message", F.to_json(F.struct("level", F.col("trace_id").alias("traceId"), F.col("fields")["event_type"].alias("kind")))),
            level="ERROR", host="host[12]", custom_fields={"kind": "error"}).withColumn("message", F.lit("json"))),
        with_logs(f"""select seq, {ISO} as ts, level, 'json' as message, service, host, trace_id
            from logs where level = 'ERROR' and host in ('host1', 'host2')""")),
    "b8_filter_attributes": (
        rows(lambda df: pred.filter_attributes(df, "warn", "svc2", "host4", attributes={"event_type": "purchase"})),
        rows_sql("level = 'WARN' and service = 'svc2' and host = 'host4'")),
    "c1_latest": (rows(lambda df: order.latest(df, 100)), rows_sql("true", "order by ts desc, seq desc limit 100")),
    "c2_first_matches": (
        rows(lambda df: order.first_matches(pred.filter_logs(df, "ERROR", tr=RANGE), 100, 300)),
        rows_sql(f"level = 'ERROR' and {RANGE_SQL}", "order by seq limit 100 offset 300")),
    "c2_first_matches_deep": (
        rows(lambda df: order.first_matches(df, 100, 7_450)), rows_sql("true", "order by seq limit 100 offset 7450")),
    "c3_page_after": (
        rows(lambda df: order.page_after(df, order.encode_cursor(datetime(2024, 1, 15, tzinfo=timezone.utc), 0), 60)),
        rows_sql("ts < timestamp '2024-01-15'", "order by ts desc, seq desc limit 60")),
    "c4_tail": (rows(lambda df: order.tail(df, 50, "refused")), rows_sql(
        "contains(message, 'refused')", "order by seq desc limit 50")),
    "c5_top_n": (
        lambda spark, sf_dir: order.top_n(agg.aggregate(logs(spark, sf_dir), ["k", "level"]), 15),
        with_logs("""select cast(k as varchar) as k, level, cast(count(*) as double) as value, count(*) as count
            from logs group by 1, 2 order by count desc, k, level limit 15""")),
    "c6_top_per_source": (rows(lambda df: order.top_per_source(df, 40)), rows_sql(
        "true", "qualify row_number() over (partition by source order by ts, seq) <= 40")),
    "c6_top_per_source_large": (rows(lambda df: order.top_per_source(df, 1500)), rows_sql(
        "true", "qualify row_number() over (partition by source order by ts, seq) <= 1500")),
    "c7_timeline": (
        lambda spark, sf_dir: order.timeline(logs(spark, sf_dir), RANGE).withColumn("ts", iso_text(F.col("ts"))),
        with_logs(f"select {ISO} as ts, source, level, service, message from logs where {RANGE_SQL}")),
    "d1_d4_errors_per_service_hour": (d1_d4_errors_per_service_hour, with_logs(f"""
        select service, {iso_sql('start')} as timestamp_bucket, cast(n as double) as value, n as count from (
          select coalesce(service, 'unknown') as service, date_trunc('hour', ts) as start, count(*) as n
          from logs where level = 'ERROR' and {RANGE_SQL} group by 1, 2) g""")),
    "d1_count": (d1_count, with_logs(f"""
        select level, coalesce(service, 'unknown') as service, event_type, cast(count(*) as double) as value,
          count(*) as count from logs where {RANGE_SQL} group by 1, 2, 3""")),
    "d1_count_all": (d1_count_all, with_logs(
        f"select cast(count(*) as double) as value, count(*) as count from logs where {RANGE_SQL}")),
    "d2_avg": (numeric("average", "value"), numeric_sql("avg(value)")),
    "d2_sum": (numeric("sum", "value"), numeric_sql("sum(value)")),
    "d2_min": (numeric("min", "value"), numeric_sql("min(value)")),
    "d2_max": (numeric("max", "k"), numeric_sql("cast(max(k) as double)")),
    "d2_not_numeric": (numeric("avg", "event_type"), numeric_sql("0.0::double")),
    "d3_keys": (d3_keys, with_logs("""
        select host, coalesce(service, 'unknown') as service, source, cast(k as varchar) as k, 'unknown' as nothing,
          count(*) as count from logs group by 1, 2, 3, 4""")),
    "d4_time_bucket_minutes": (bucketed("7m"), bucketed_sql(
        "date_trunc('hour', ts) + to_minutes(minute(ts) // 7 * 7)")),
    "d4_time_bucket_hours": (bucketed("5h"), bucketed_sql("date_trunc('day', ts) + to_hours(hour(ts) // 5 * 5)")),
    "d4_time_bucket_days": (bucketed("3d"), bucketed_sql("date_trunc('day', ts)")),
    "d5_epoch_bucket": (d5_epoch_bucket, with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, source, n as count from (
          select time_bucket(interval 7 minute, ts, timestamp '1970-01-01') as start, source, count(*) as n
          from logs group by 1, 2) g""")),
    "d6_over_time": (over("count", ["level"]), over_sql("count(*)::double")),
    "d6_over_time_avg": (over("avg", ["level"], "value"), over_sql("avg(value)")),
    "d6_over_time_max": (over("max", ["level"], "value"), over_sql("max(value)")),
    "d7_stats_by": (d7_stats_by, with_logs(f"""
        select host as log_stream, level, {r4('avg(value)')} as value
        from logs group by 1, 2 order by avg(value) desc, 1, 2 limit 20""")),
    "d7_stats_by_bins": (d7_stats_by_bins, with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, cast(n as double) as value from (
          select time_bucket(interval 5 minute, ts, timestamp '1970-01-01') as start, count(*) as n
          from logs group by 1) g""")),
    "d8_facet_counts": (d8_facet_counts, with_logs(
        f"""select host, status, k, {r4('max(value)')} as value, count(*) as count from f
           where host in (select host from h) and status in (select status from s) and k in (select k from ks)
           group by 1, 2, 3""",
        "f as (select host, lower(level) as status, cast(k as varchar) as k, value from logs)",
        "h as (select host from f group by 1 order by count(*) desc, 1 limit 4)",
        "s as (select status from f group by 1 order by count(*) desc, 1 limit 4)",
        "ks as (select k from f group by 1 order by count(*) desc, 1 limit 4)")),
    "d8_facet_counts_by_time": (d8_facet_counts_by_time, with_logs(f"""
        select {ISO} as timestamp, 1.0::double as value, 1::bigint as count
        from (select ts from logs order by ts limit 25) l""")),
    "d9_total": (lambda spark, sf_dir: agg.total(logs(spark, sf_dir), RECENT),
                 with_logs(f"select count(*) as total from logs where {RECENT_SQL}")),
    "d10_summarize": (d10_summarize, D10_SQL),
    "d10_histograms": (d10_histograms, with_logs("""
        select 'level' as kind, level as key, count(*) as count from logs group by 2
        union all select 'service', coalesce(service, 'unknown'), count(*) from logs group by 2
        union all select 'message', message, count(*) from logs group by 2
        union all select 'total', null, count(*) from logs""")),
    "i1_tag_level": (tagged(level=questions.tag_level),
                     f"select conv_id, turn, {level_case('lower(text)')} as level from conversations"),
    "i2_tag_service_host": (
        tagged(service=questions.tag_service, host=questions.tag_host),
        f"""select conv_id, turn, {word_after('lower(text)', questions.SERVICE_PREFIXES)} as service,
            {word_after('lower(text)', questions.HOST_PREFIXES)} as host from conversations"""),
    "i3_tag_time_range": (tagged(time_range=questions.tag_time_range),
                          f"select conv_id, turn, {phrase_case('lower(text)')} as time_range from conversations"),
    "i4_tag_keyword": (tagged(keyword=questions.tag_keyword),
                       f"select conv_id, turn, {KEYWORD_SQL} as keyword from conversations"),
    "i_tag_questions": (i_tag_questions, with_logs(f"""
        select seq, {level_case('lower(text)')} as level,
          {word_after('lower(text)', questions.SERVICE_PREFIXES)} as service,
          {word_after('lower(text)', questions.HOST_PREFIXES)} as host,
          {phrase_case('lower(text)')} as time_range, {KEYWORD_SQL} as keyword from asked""", GENERATED_SQL)),
}
