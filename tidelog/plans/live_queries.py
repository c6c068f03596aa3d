"""Queries for live tables (S): what a stream keeps up to date over several arrivals of input, with restarts between.

Inputs arrive as several loads of files, made from the given tables; after each load the stream runs to the end of its
present input, stops, and goes on from its progress with the next load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import sources as src
from ..schema import LOG_SCHEMA
from ..session import shared_dir
from ..streaming import cells, deltas, files, windows
from ..streaming import follow as live
from .analysis_queries import GROUPS_SQL, islands_sql, times
from .events import iso_sql, logs, with_logs
from .log_queries import r4, rounded
from .source_queries import ENTRY_SQL, document_lines, entry_columns, json_lines

ARRIVALS = 3


def in_turn(rows: DataFrame, arrival, folder: str, run) -> None:
    """Writes the rows of each arrival (a column from 0) into the folder, and runs the stream after each."""
    numbered = rows.withColumn("arrival", arrival)
    for i in range(ARRIVALS):
        numbered.where(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(folder)
        run()


def log_stream(spark, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).parquet(folder)


def by_time(df: DataFrame):
    """The arrival of rows that come in the order of time: equal spans of time."""
    first, last = df.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    if first is None:
        return F.lit(0)
    return F.call_function("div", (F.unix_micros("ts") - first) * ARRIVALS, F.lit(last - first + 1))


def s1_live_files(spark, sf_dir):
    """JSON line files that arrive in folders, as one log table; lines keep their numbers over all loads."""
    folder, out = shared_dir(spark, "live-files"), shared_dir(spark, "live-table")
    lines = json_lines(spark, sf_dir)
    size = lines.agg(F.coalesce(F.max("line_pos"), F.lit(0)) + 1).first()[0]
    lines = lines.withColumn("arrival", F.call_function("div", F.col("line_pos") * ARRIVALS, F.lit(size)))
    for i in range(ARRIVALS):
        own = lines.where(F.col("arrival") == i).orderBy("line_pos").select("value")
        own.write.option("lineSep", "\n").text(f"{folder}/load {i}")
        opts = src.LineOptions(host_field="host")
        files.follow_files(spark, f"{folder}/**/part-[0-9]*.txt", "files", out, opts=opts).awaitTermination()
    found = files.read_live_table(spark, out)
    return entry_columns(found, "source", F.col("dt").cast("string").alias("dt"))


def s1_live_plain_lines(spark, sf_dir):
    """Plain document lines from two sources in one live table: what arrived how often, and how the lines are numbered."""
    folder, out = shared_dir(spark, "live-files"), shared_dir(spark, "live-table")
    lines = document_lines(spark, sf_dir).withColumn("arrival", F.pmod(F.xxhash64("value"), F.lit(ARRIVALS)))
    for i in range(ARRIVALS):
        for name in ("a", "b"):
            own = lines.where((F.col("arrival") == i) & ((F.length("value") % 2 == 0) == F.lit(name == "a"))).select("value")
            own.write.text(f"{folder}/{name}/load-{i}")
            files.follow_files(spark, f"{folder}/{name}/**", name, out, json=False).awaitTermination()
    found = files.read_live_table(spark, out)
    return found.groupBy("source", "level", F.col("message").alias("line")).agg(F.count("*").alias("n"))


def s2_open_windows(spark, sf_dir):
    """All hours so far in their last version, those that the watermark has not closed included."""
    given, out = shared_dir(spark, "live-input"), shared_dir(spark, "live-windows")
    rows = logs(spark, sf_dir)

    def run():
        found = live.follow_aggregate(log_stream(spark, given), ["level"], "1h", "30m", "avg", "value")
        deltas.run_to_latest(found, out, ["timestamp_bucket", "level"])

    in_turn(rows, by_time(rows), given, run)
    schema = live.follow_aggregate(rows, ["level"], "1h", "30m", "avg", "value").schema
    found = deltas.read_folded(spark, out, schema, deltas.latest(["timestamp_bucket", "level"]))
    return times(rounded(found, "value"), "timestamp_bucket")


def late_windows(spark, sf_dir) -> str:
    """Hours by service of entries whose thirds arrive one after the other, each over the whole time."""
    given, out = shared_dir(spark, "live-input"), shared_dir(spark, "live-windows")

    def run():
        windows.follow_windows(log_stream(spark, given), out, ["service"], "1h", "7d", "value").awaitTermination()

    in_turn(logs(spark, sf_dir), F.col("seq") % ARRIVALS, given, run)
    return out


def s2_windows_on_time(spark, sf_dir):
    found = windows.live_windows(spark, late_windows(spark, sf_dir), ["service"], "max")
    return times(rounded(found, "value"), "timestamp_bucket")


def s2_late_entries(spark, sf_dir):
    found = windows.late_entries(spark, late_windows(spark, sf_dir))
    return times(found, "watermark", "newest")


def live_chains(window, service=None):
    def query(spark, sf_dir):
        given, out = shared_dir(spark, "live-input"), shared_dir(spark, "live-cells")

        def run():
            cells.follow_cells(log_stream(spark, given), out, window, compact=2).awaitTermination()

        in_turn(logs(spark, sf_dir), F.col("seq") % ARRIVALS, given, run)
        return times(cells.live_chains(spark, out, window, service), "start_ts", "end_ts")

    return query


ARRIVED_SQL = f"""arrived as (
  select *, seq % {ARRIVALS} as batch, date_trunc('hour', ts) as start from logs),
marks as (
  select batch, max(newest) over (order by batch) as newest,
    max(newest) over (order by batch rows between unbounded preceding and 1 preceding) - interval 7 day as watermark
  from (select batch, max(ts) as newest from arrived group by batch) m),
judged as (
  select a.*, m.newest, m.watermark, coalesce(a.start + interval 1 hour <= m.watermark, false) as late
  from arrived a join marks m using (batch))"""

QUERIES = {
    "s1_live_files": (s1_live_files, with_logs(
        f"select {ENTRY_SQL}, 'files' as source, strftime(ts, '%Y-%m-%d') as dt from logs")),
    "s1_live_plain_lines": (s1_live_plain_lines, """
        with raw as (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as raw from documents),
        lines as (select case when length(raw) % 2 = 0 then 'a' else 'b' end as source,
          regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from raw)
        select source, 'UNKNOWN' as level, line, count(*) as n from lines where line <> '' group by all"""),
    "s2_open_windows": (s2_open_windows, with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, level, {r4('v')} as value, n as count from (
          select date_trunc('hour', ts) as start, level, avg(value) as v, count(*) as n from logs group by 1, 2) g""")),
    "s2_windows_on_time": (s2_windows_on_time, with_logs(f"""
        select {iso_sql('start')} as timestamp_bucket, coalesce(service, 'unknown') as service, {r4('max(value)')} as value,
          count(*) as count from judged where not late group by start, coalesce(service, 'unknown')""", ARRIVED_SQL)),
    "s2_late_entries": (s2_late_entries, with_logs(f"""
        select cast(batch as int) as batch, {iso_sql('watermark')} as watermark, {iso_sql('newest')} as newest,
          count(*) as entries, count(*) filter (late) as late from judged group by batch, watermark, newest""", ARRIVED_SQL)),
    "s3_live_chains": (live_chains("5m"), islands_sql(300, "true", GROUPS_SQL)),
    "s3_live_chains_service": (live_chains("1h", "svc3"), islands_sql(3600, "service = 'svc3'", GROUPS_SQL)),
}
