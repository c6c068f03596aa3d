"""Queries for correlation (E), root cause (F), comparison (G), detection (H) and streams (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timeexpr import TimeRange
from ..functions.timestamps import iso_text
from ..functions.values import percent_change
from ..operators import compare, correlate, detect
from ..operators import root_cause as rc
from ..streaming import follow as live
from ..streaming.run import keep_model, run_to_table
from .events import as_logs, event_stream, iso_sql, logs, with_logs
from .log_queries import RANGE, RANGE_SQL, r4, rounded
from .source_queries import ENTRY_SQL, entry_columns

BASELINE = TimeRange.of("2024-01-05T00:00:00Z", "2024-01-09T23:59:59Z")
COMPARISON = TimeRange.of("2024-01-09T12:00:00Z", "2024-01-22T00:00:00Z")
BASELINE_SQL = "ts between timestamp '2024-01-05' and timestamp '2024-01-09 23:59:59'"
COMPARISON_SQL = "ts between timestamp '2024-01-09 12:00:00' and timestamp '2024-01-22'"


def times(df: DataFrame, *names) -> DataFrame:
    return df.select(*[iso_text(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def islands_sql(seconds, condition, tail, *more):
    """Gaps and islands in the direct form: lag over all rows, then a running sum of the breaks."""
    return with_logs(
        tail,
        f"chosen as (select * from logs where {condition})",
        f"""stepped as (select *, case when ts - lag(ts) over (order by ts) <= interval {seconds} second
              then 0 else 1 end as step from chosen)""",
        "labelled as (select *, sum(step) over (order by ts rows unbounded preceding) as g from stepped)",
        """groups as (select g, min(ts) as start_ts, max(ts) as end_ts, count(*) as entries,
              round(least(count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) / count(*) + 0.1, 1.0), 2) as score
              from labelled group by g)""",
        *more,
    )


GROUPS_SQL = f"""select cast(g as bigint) as group_id, 'timestamp_proximity' as correlation_type,
  {iso_sql('start_ts')} || ' to ' || {iso_sql('end_ts')} as correlation_key, score,
  {iso_sql('start_ts')} as start_ts, {iso_sql('end_ts')} as end_ts, entries from groups"""


def time_groups(window, service=None, tr=None):
    def query(spark, sf_dir):
        found = correlate.correlate_time(logs(spark, sf_dir), window, service, tr)
        return times(found, "start_ts", "end_ts")

    return query


def e1_correlate_trace(spark, sf_dir):
    found = correlate.correlate_trace(logs(spark, sf_dir), "trace-41", ["src0", "src2"])
    return entry_columns(found, "source")


def e1_trace_groups(spark, sf_dir):
    return times(correlate.trace_groups(logs(spark, sf_dir)), "start_ts", "end_ts")


def e2_correlated_entries(spark, sf_dir):
    found = correlate.correlated_entries(logs(spark, sf_dir), "4m")
    return found.select("seq", "group_id")


def e3_group_score(spark, sf_dir):
    per = logs(spark, sf_dir).groupBy("trace_id").agg(
        F.count_if(F.col("level").isin("ERROR", "WARN", "WARNING")).alias("alarms"), F.count("*").alias("n")
    )
    return per.select("trace_id", correlate.group_score(F.col("alarms"), F.col("n")).alias("score"))


def e4_correlate(spark, sf_dir):
    found = correlate.correlate(logs(spark, sf_dir), ["src0", "src1"], "trace-41", "svc2", "30m")
    return times(found.drop("group_id"), "start_ts", "end_ts")


def e4_correlate_entries(spark, sf_dir):
    found = correlate.correlate_entries(logs(spark, sf_dir), ["src0", "src1"], "trace-41", "svc2", "30m")
    return found.select("group_id", "source", "seq")


def e4_correlate_total(spark, sf_dir):
    return correlate.correlate_total(logs(spark, sf_dir), ["src0", "src1"], "trace-41", "svc2", RANGE)


def f1_incident_errors(spark, sf_dir):
    return entry_columns(rc.incident_errors(logs(spark, sf_dir), "svc1", RANGE))


def f2_incident_context(spark, sf_dir):
    return times(rc.incident_context(logs(spark, sf_dir), RANGE, ["src0", "src1"]), "ts")


INCIDENT = TimeRange.of("2024-01-10T00:00:00Z", "2024-01-10T01:30:00Z")
INCIDENT_SQL = "ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-10 01:30:00'"


def causes(operator, tr):
    return lambda spark, sf_dir: operator(logs(spark, sf_dir), "svc1", tr)


def f8_root_cause(spark, sf_dir):
    found = rc.root_cause(logs(spark, sf_dir), "svc1", INCIDENT, "slow checkout")
    report = found.report.select(F.lit(0).alias("rank"), F.concat_ws(": ", "service", "symptom").alias("cause"),
                                 F.lit(None).cast("double").alias("confidence"),
                                 F.concat("error_count", F.lit(" errors")).alias("evidence"))
    return report.unionByName(found.causes)


def cause_views(condition):
    return (
        f"win as (select *, coalesce(service, 'unknown') as svc from logs where {condition})",
        "own as (select * from win where level = 'ERROR' and service = 'svc1')",
        "warned as (select count(*) as n from win where level in ('WARN', 'WARNING'))",
        """upstream as (select 'Errors in upstream service ''' || svc || '''' as cause,
             round(least(0.5 + 0.05 * count(*), 0.95), 4)::double as confidence,
             count(*) || ' error(s) from ' || svc || ' during incident window' as evidence, 1 as h, count(*) as n, svc as key
           from win where level = 'ERROR' and svc <> 'svc1' group by svc)""",
        """recurring as (select 'Recurring error: ' || substring(message, 1, 80) as cause,
             round(least(0.4 + 0.05 * count(*), 0.9), 4)::double as confidence,
             count(*) || ' occurrence(s)' as evidence, 2 as h, count(*) as n, message as key
           from own group by message order by n desc, key limit 3)""",
        """keywords as (select 'Infrastructure issue: ''' || w || ''' detected' as cause,
             round(least(0.45 + 0.05 * count(*), 0.85), 4)::double as confidence,
             count(*) || ' error(s) mention ''' || w || '''' as evidence, 3 as h, count(*) as n, w as key
           from own join (values ('timeout'), ('connection'), ('database'), ('db'), ('refused'), ('unavailable')) v(w)
             on contains(lower(message), w) group by w)""",
        """spike as (select 'Warning spike preceding errors' as cause, 0.6::double as confidence,
             w.n || ' warnings vs ' || e.n || ' errors' as evidence, 4 as h, w.n as n, '' as key
           from warned w, (select count(*) as n from own) e where w.n > e.n)""",
        "every as (select * from upstream union all select * from recurring union all select * from keywords union all select * from spike)",
        """ranked as (select row_number() over (order by confidence desc, h, n desc, key) as rank, cause, confidence, evidence
           from (select * from every qualify row_number() over (partition by cause order by confidence desc, h, n desc, key) = 1) u)""",
    )


def cause_sql(view, condition):
    return with_logs(f"select cause, confidence, evidence from {view}", *cause_views(condition))


def counts(spark, sf_dir):
    return compare.period_counts(logs(spark, sf_dir), BASELINE, COMPARISON)


def g1_period_counts(spark, sf_dir):
    return counts(spark, sf_dir)


def g1_period_stats(spark, sf_dir):
    return compare.period_stats(logs(spark, sf_dir), COMPARISON, "svc3")


def g1_top_messages(spark, sf_dir):
    return compare.top_keys(counts(spark, sf_dir), compare.MESSAGE, "comparison")


def g2_g3_changes(spark, sf_dir):
    """Change of volume and of error rate per service."""
    found = counts(spark, sf_dir).where(F.col("kind") == compare.SERVICE)
    rates = [compare.error_rate(F.col(f"{p}_errors"), F.col(p)) for p in ("baseline", "comparison")]
    return found.select(
        F.col("key").alias("service"),
        percent_change(F.col("baseline"), F.col("comparison")).alias("change"),
        F.round(rates[1] - rates[0], 4).alias("rate_change"),
    )


NARROW = TimeRange.of("2024-01-05T00:00:00Z", "2024-01-05T01:00:00Z")
NARROW_SQL = "ts between timestamp '2024-01-05' and timestamp '2024-01-05 01:00:00'"


def g4_new_messages(spark, sf_dir):
    found = compare.period_counts(logs(spark, sf_dir), NARROW, COMPARISON, "error")
    return compare.new_messages(found)


def g4_disappeared_messages(spark, sf_dir):
    found = compare.period_counts(logs(spark, sf_dir), COMPARISON, NARROW, "error")
    return compare.disappeared_messages(found)


def g5_compare_periods(spark, sf_dir):
    found = compare.compare_periods(logs(spark, sf_dir), NARROW, COMPARISON, "error")
    lists = [c for c in found.columns if c.startswith(("top_", "services_"))]

    def flat(name):
        spelled = F.transform(name, lambda e: F.concat(e["key"], F.lit("="), e["count"].cast("string")))
        return F.array_join(spelled, "|").alias(name)

    return found.select(*[flat(c) if c in lists else F.col(c) for c in found.columns])


ERROR_HIT = "contains(lower(concat_ws('|', message, service, host, event_type)), 'error')"

_TOPS = {
    "top_messages_baseline": ("message", NARROW_SQL),
    "top_messages_comparison": ("message", COMPARISON_SQL),
    "services_baseline": ("svc", NARROW_SQL),
    "services_comparison": ("svc", COMPARISON_SQL),
}


def _top_sql(name):
    key, period = _TOPS[name]
    return f"""coalesce((select string_agg({key} || '=' || n, '|' order by n desc, {key}) from
      (select {key}, count(*) as n from hit where {period} group by 1 order by n desc, 1 limit 5) t), '') as {name}"""


def _pct_sql(before, after):
    return f"""case when {before} = 0 and {after} > 0 then 'inf'::double when {before} = 0 then 0.0::double
      else round(({after} - {before}) / {before} * 100, 2) end"""


def _change_text(change, word, stable):
    return f"""case when {change} = 'inf'::double then '{word} went from zero to present.'
      when {change} > 50 then '{word} increased by ' || {change}::varchar || '%.'
      when {change} < -50 then '{word} decreased by ' || abs({change})::varchar || '%.' else '{stable}' end"""


G5_SQL = with_logs(
    f"""select bt as baseline_total, ct as comparison_total, be as baseline_errors, ce as comparison_errors,
      (select count(*) from fresh) as new_messages, (select count(*) from gone) as disappeared_messages,
      {', '.join(_top_sql(n) for n in _TOPS)},
      total_change, error_change, round(be / greatest(bt, 1), 4) as baseline_rate,
      round(ce / greatest(ct, 1), 4) as comparison_rate,
      round(ce / greatest(ct, 1) - be / greatest(bt, 1), 4) as rate_change,
      {_change_text('total_change', 'Log volume', 'Log volume is relatively stable.')} || ' ' ||
      {_change_text('error_change', 'Errors', 'Error rate is relatively stable.')} ||
      coalesce((select ' New messages appeared: ' || string_agg(message, ', ' order by message) || '.'
        from (select message from fresh order by message limit 3) f), '') as summary
    from (select *, {_pct_sql('bt', 'ct')} as total_change, {_pct_sql('be', 'ce')} as error_change from sums) s""",
    f"hit as (select *, coalesce(service, 'unknown') as svc from logs where {ERROR_HIT} or lower(level) = 'error')",
    f"""sums as (select count(*) filter ({NARROW_SQL}) as bt, count(*) filter ({COMPARISON_SQL}) as ct,
       count(*) filter ({NARROW_SQL} and level in ('ERROR', 'WARN', 'WARNING')) as be,
       count(*) filter ({COMPARISON_SQL} and level in ('ERROR', 'WARN', 'WARNING')) as ce from hit)""",
    f"fresh as (select message from hit where {COMPARISON_SQL} except select message from hit where {NARROW_SQL})",
    f"gone as (select message from hit where {NARROW_SQL} except select message from hit where {COMPARISON_SQL})",
)


def h1_detect_error_patterns(spark, sf_dir):
    found = detect.detect_error_patterns(logs(spark, sf_dir), RANGE, min_occurrences=5)
    return times(found, "first_seen", "last_seen").withColumn(
        "sample_messages", F.array_join("sample_messages", "|")
    ).withColumn("services", F.array_join("services", "|"))


def h1_total_errors(spark, sf_dir):
    return detect.total_errors(logs(spark, sf_dir), RANGE, "svc2")


def anomalies(metric, sensitivity, bucket, by=(), field="value"):
    def query(spark, sf_dir):
        found = detect.find_anomalies(logs(spark, sf_dir), None, metric, sensitivity, bucket, by, field)
        found = rounded(found, "expected_value", "actual_value", "deviation_score")
        return times(found, "timestamp_bucket")

    return query


def anomalies_sql(value, threshold, bucket, filled, key="'all'", more=""):
    start = f"time_bucket(interval {bucket}, ts, timestamp '1970-01-01')"
    grid = f"""select key, unnest(generate_series(min(b), max(b), interval {bucket})) as b from s group by key"""
    points = "s" if not filled else f"(select g.key, g.b, coalesce(s.v, 0.0) as v from ({grid}) g left join s using (key, b))"
    shown = "" if key == "'all'" else "key as source, "
    return with_logs(
        f"""select {shown}{iso_sql('b')} as timestamp_bucket, {r4('mean')} as expected_value,
          {r4('v')} as actual_value, {r4(f'abs(v - mean) / sd / {threshold}')} as deviation_score
        from (select *, avg(v) over (partition by key) as mean, stddev_samp(v) over (partition by key) as sd
              from {points} p) z where sd > 0 and abs(v - mean) / sd / {threshold} > 1 {more}""",
        f"s as (select {key} as key, {start} as b, {value} as v from logs group by 1, 2)",
    )


def closed_sql(end, lateness):
    """Append output holds what ended before the watermark, which counts whole milliseconds."""
    return f"{end} <= (select date_trunc('millisecond', max(ts)) from logs) - interval {lateness}"


def s1_follow(spark, sf_dir):
    found = live.follow(as_logs(event_stream(spark, sf_dir)), "timeout", service="svc2")
    return entry_columns(run_to_table(found))


def s2_follow_aggregate(spark, sf_dir):
    found = live.follow_aggregate(as_logs(event_stream(spark, sf_dir)), ["level"], "1h", "30m", "avg", "value")
    return times(rounded(run_to_table(found), "value"), "timestamp_bucket")


def s3_follow_correlate(spark, sf_dir):
    found = live.follow_correlate(as_logs(event_stream(spark, sf_dir)), "20m", "service", "1h")
    return times(run_to_table(found), "start_ts", "end_ts")


def s4_follow_anomalies(spark, sf_dir):
    model = keep_model(detect.anomaly_model(logs(spark, sf_dir), bucket="6h", by=["source"]))
    found = live.follow_anomalies(as_logs(event_stream(spark, sf_dir)), model, bucket="6h", sensitivity="high")
    found = rounded(run_to_table(found), "expected_value", "actual_value", "deviation_score")
    return times(found, "timestamp_bucket")


ISO = iso_sql("ts")

QUERIES = {
    "e1_correlate_trace": (e1_correlate_trace, with_logs(
        f"select {ENTRY_SQL}, source from logs where trace_id = 'trace-41' and source in ('src0', 'src2')")),
    "e1_trace_groups": (e1_trace_groups, with_logs(f"""
        select trace_id, count(*) as entries, {iso_sql('min(ts)')} as start_ts, {iso_sql('max(ts)')} as end_ts,
          count(distinct source) as sources, count(distinct service) as services from logs group by trace_id""")),
    "e2_correlate_time": (time_groups("5m"), islands_sql(300, "true", GROUPS_SQL)),
    "e2_correlate_time_service": (
        time_groups("1h", "svc3", RANGE), islands_sql(3600, f"service = 'svc3' and {RANGE_SQL}", GROUPS_SQL)),
    "e2_correlate_time_seconds": (time_groups("45s"), islands_sql(45, "true", GROUPS_SQL)),
    "e2_correlated_entries": (e2_correlated_entries, islands_sql(
        240, "true", "select seq, cast(g as bigint) as group_id from labelled")),
    "e3_group_score": (e3_group_score, with_logs("""
        select trace_id, round(least(count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) / count(*) + 0.1, 1.0), 2)
          as score from logs group by trace_id""")),
    "e4_correlate": (e4_correlate, islands_sql(
        1800, "service = 'svc2' and source in ('src0', 'src1')", f"""
        select 'timestamp_proximity' as correlation_type, {iso_sql('start_ts')} || ' to ' || {iso_sql('end_ts')} as correlation_key,
          score, {iso_sql('start_ts')} as start_ts, {iso_sql('end_ts')} as end_ts, entries from groups
        union all select 'trace_id', 'trace-41', 1.0, {iso_sql('min(ts)')}, {iso_sql('max(ts)')}, count(*)
        from logs where trace_id = 'trace-41' and source in ('src0', 'src1')""")),
    "e4_correlate_entries": (e4_correlate_entries, islands_sql(
        1800, "service = 'svc2' and source in ('src0', 'src1')", """
        select cast(g as bigint) as group_id, source, seq from labelled
        union all select 0, source, seq from logs where trace_id = 'trace-41' and source in ('src0', 'src1')""")),
    "e4_correlate_total": (e4_correlate_total, with_logs(f"""
        select count(*) + count(*) filter (trace_id = 'trace-41') as total_entries
        from logs where source in ('src0', 'src1') and {RANGE_SQL}""")),
    "f1_incident_errors": (f1_incident_errors, with_logs(
        f"select {ENTRY_SQL} from logs where level = 'ERROR' and service = 'svc1' and {RANGE_SQL}")),
    "f2_incident_context": (f2_incident_context, with_logs(
        f"select {ISO} as ts, source, level, service, message from logs where source in ('src0', 'src1') and {RANGE_SQL}")),
    "f3_upstream_errors": (causes(rc.upstream_errors, INCIDENT), cause_sql("upstream", INCIDENT_SQL)),
    "f4_recurring_messages": (causes(rc.recurring_messages, RANGE), cause_sql("recurring", RANGE_SQL)),
    "f5_infrastructure_keywords": (causes(rc.infrastructure_keywords, INCIDENT), cause_sql("keywords", INCIDENT_SQL)),
    "f6_warning_spike": (causes(rc.warning_spike, RANGE), cause_sql("spike", RANGE_SQL)),
    "f7_rank_causes": (causes(rc.rank_causes, RANGE), with_logs(
        "select * from ranked where rank <= 5", *cause_views(RANGE_SQL))),
    "f8_root_cause": (f8_root_cause, with_logs(
        """select rank, cause, confidence, evidence from ranked where rank <= 5
           union all select 0, 'svc1: slow checkout', null, count(*) || ' errors' from own""", *cause_views(INCIDENT_SQL))),
    "g1_period_counts": (g1_period_counts, with_logs(
        """select 'message' as kind, message as key, baseline, comparison, baseline_errors, comparison_errors from
             (select message, count(*) filter (b) as baseline, count(*) filter (c) as comparison,
              count(*) filter (b and bad) as baseline_errors, count(*) filter (c and bad) as comparison_errors from t group by 1) m
           union all select 'service', svc, count(*) filter (b), count(*) filter (c), count(*) filter (b and bad), count(*) filter (c and bad) from t group by 2
           union all select 'total', null, count(*) filter (b), count(*) filter (c), count(*) filter (b and bad), count(*) filter (c and bad) from t""",
        f"""t as (select message, coalesce(service, 'unknown') as svc, level in ('ERROR', 'WARN', 'WARNING') as bad,
              {BASELINE_SQL} as b, {COMPARISON_SQL} as c from logs where {BASELINE_SQL} or {COMPARISON_SQL})""")),
    "g1_period_stats": (g1_period_stats, with_logs(f"""
        select count(*) as total, count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) as errors,
          round(count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) / count(*), 4) as error_rate
        from logs where service = 'svc3' and {COMPARISON_SQL}""")),
    "g1_top_messages": (g1_top_messages, with_logs(f"""
        select message as key, count(*) as count from logs where {COMPARISON_SQL}
        group by 1 order by count desc, key limit 5""")),
    "g2_g3_changes": (g2_g3_changes, with_logs(
        f"""select service, {_pct_sql('b', 'c')} as change,
            round(ce / greatest(c, 1) - be / greatest(b, 1), 4) as rate_change from t where b + c > 0""",
        f"""t as (select coalesce(service, 'unknown') as service, count(*) filter ({BASELINE_SQL}) as b,
            count(*) filter ({COMPARISON_SQL}) as c,
            count(*) filter ({BASELINE_SQL} and level in ('ERROR', 'WARN', 'WARNING')) as be,
            count(*) filter ({COMPARISON_SQL} and level in ('ERROR', 'WARN', 'WARNING')) as ce from logs group by 1)""")),
    "g4_new_messages": (g4_new_messages, with_logs(
        f"""select message from logs where {COMPARISON_SQL} and (level = 'ERROR' or {ERROR_HIT})
        except select message from logs where {NARROW_SQL} and (level = 'ERROR' or {ERROR_HIT})""")),
    "g4_disappeared_messages": (g4_disappeared_messages, with_logs(
        f"""select message from logs where {COMPARISON_SQL} and (level = 'ERROR' or {ERROR_HIT})
        except select message from logs where {NARROW_SQL} and (level = 'ERROR' or {ERROR_HIT})""")),
    "g5_compare_periods": (g5_compare_periods, G5_SQL),
    "h1_detect_error_patterns": (h1_detect_error_patterns, with_logs(f"""
        select pattern, count(*) as count, {iso_sql('min(ts)')} as first_seen, {iso_sql('max(ts)')} as last_seen,
          array_to_string(list_sort(list_distinct(list(message)))[1:3], '|') as sample_messages,
          array_to_string(list_sort(list_distinct(list(service) filter (service is not null))), '|') as services
        from (select *, regexp_replace(message, '[0-9]+', '<NUM>', 'g') as pattern from logs
              where level = 'ERROR' and {RANGE_SQL}) e group by pattern having count(*) >= 5""")),
    "h1_total_errors": (h1_total_errors, with_logs(
        f"select count(*) as total_errors from logs where level = 'ERROR' and service = 'svc2' and {RANGE_SQL}")),
    "h2_anomalies_volume": (anomalies("log_volume", "high", "1h"), anomalies_sql(
        "count(*)::double", 1.5, "1 hour", True)),
    "h2_anomalies_volume_by_source": (anomalies("log_volume", "medium", "6h", ["source"]), anomalies_sql(
        "count(*)::double", 2.0, "6 hour", True, "source")),
    "h2_anomalies_error_rate": (anomalies("error_rate", "high", "1h"), anomalies_sql(
        "count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) / count(*)", 1.5, "1 hour", False)),
    "h2_anomalies_latency": (anomalies("latency", "medium", "2h"), anomalies_sql("avg(value)", 2.0, "2 hour", False)),
    "s1_follow": (s1_follow, with_logs(
        f"select {ENTRY_SQL} from logs where contains(message, 'timeout') and service = 'svc2'")),
    "s2_follow_aggregate": (s2_follow_aggregate, with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, level, {r4('v')} as value, n as count from (
          select date_trunc('hour', ts) as start, level, avg(value) as v, count(*) as n from logs group by 1, 2) g
        where {closed_sql("start + interval 1 hour", "30 minute")}""")),
    "s3_follow_correlate": (s3_follow_correlate, with_logs(
        f"""select service, {iso_sql('min(ts)')} as start_ts, {iso_sql('max(ts)')} as end_ts, count(*) as entries,
          round(least(count(*) filter (level in ('ERROR', 'WARN', 'WARNING')) / count(*) + 0.1, 1.0), 2) as score
        from (select *, sum(step) over (partition by service order by ts rows unbounded preceding) as g from st) l
        group by service, g having {closed_sql("max(l.ts) + interval 20 minute", "1 hour")}""",
        """st as (select *, case when ts - lag(ts) over (partition by service order by ts) <= interval 20 minute
             then 0 else 1 end as step from logs where service is not null)""")),
    "s4_follow_anomalies": (s4_follow_anomalies, anomalies_sql(
        "count(*)::double", 1.5, "6 hour", True, "source", f"and v > 0 and {closed_sql('b + interval 6 hour', '10 minute')}")),
}
