"""Queries of a written log table by its side tables, and of the most frequent values."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..functions.timeexpr import TimeRange
from ..operators import frequent
from ..operators.correlate import correlate_trace
from ..session import shared_dir
from ..sources import zones
from .analysis_queries import times
from .events import iso_sql, logs, with_logs
from .source_queries import ENTRY_SQL, entry_columns

PARTS = 4
DAYS = TimeRange.of("2024-01-05T06:00:00Z", "2024-01-20T18:00:00Z")


def log_table(spark, sf_dir, trigrams=False) -> str:
    """The log view as a table with side tables, written in several loads."""
    path = shared_dir(spark, "table")
    view = logs(spark, sf_dir).withColumn("part", F.col("seq") % PARTS)
    for part in range(PARTS):
        # A load goes on behind the greatest number of each source; here the entries keep their own.
        load = view.where(F.col("part") == part).drop("part")
        dated = src.tables.with_day(load)
        dated.repartitionByRange("source", "dt", "ts").write.mode("append").partitionBy("source", "dt").parquet(path)
        zones.update_zones(spark, path)
    if trigrams:
        zones.update_trigrams(spark, path)
    return path


def c4_tail_of_table(spark, sf_dir):
    return entry_columns(zones.tail_of_table(spark, log_table(spark, sf_dir), 60))


def c4_tail_of_table_search(spark, sf_dir):
    return entry_columns(zones.tail_of_table(spark, log_table(spark, sf_dir), 25, "database"))


def c2_page_of_table(spark, sf_dir):
    return entry_columns(zones.page_of_table(spark, log_table(spark, sf_dir), 100, 450))


def b1_search_table(spark, sf_dir):
    return entry_columns(zones.search_table(spark, log_table(spark, sf_dir, trigrams=True), "Refused code 1"))


def a14_sources_of_table(spark, sf_dir):
    return times(zones.sources_of_table(spark, log_table(spark, sf_dir)), "first_ts", "last_ts")


def d9_total_of_table(spark, sf_dir):
    path = log_table(spark, sf_dir)
    return spark.createDataFrame([(zones.total_of_table(spark, path, DAYS),)], "total bigint")


def e1_trace_of_table(spark, sf_dir):
    path = shared_dir(spark, "table")
    src.write_log_table(logs(spark, sf_dir), path)
    return entry_columns(correlate_trace(src.read_log_table(spark, path), "trace-41"), "source")


def a16_nested_keys(spark, sf_dir):
    """The keys of lines whose objects differ by source."""
    only = F.when(F.col("source") == "src1", F.struct(F.col("level").alias("lvl"), F.col("seq").alias("id")))
    doc = F.struct(
        F.struct(F.struct(F.col("host").alias("name"), (F.col("seq") % 2 == 0).alias("even")).alias("at"), F.array("level").alias("tags")).alias("meta"),
        F.array(F.struct(F.col("message").alias("text"))).alias("parts"), only.alias("only"),
    )
    lines = logs(spark, sf_dir).select("source", F.col("seq").alias("line_pos"), F.to_json(doc).alias("value"))
    return src.nested_keys(src.parse_json_lines(lines))


def d10_most_frequent(spark, sf_dir):
    return frequent.most_frequent(logs(spark, sf_dir), "message", 5)


QUERIES = {
    "c4_tail_of_table": (c4_tail_of_table, with_logs(f"select {ENTRY_SQL} from logs order by seq desc limit 60")),
    "c4_tail_of_table_search": (c4_tail_of_table_search, with_logs(
        f"select {ENTRY_SQL} from logs where contains(message, 'database') order by seq desc limit 25")),
    "c2_page_of_table": (c2_page_of_table, with_logs(f"select {ENTRY_SQL} from logs order by seq limit 100 offset 450")),
    "b1_search_table": (b1_search_table, with_logs(f"select {ENTRY_SQL} from logs where contains(message, 'refused code 1')")),
    "a14_sources_of_table": (a14_sources_of_table, with_logs(f"""
        select source, count(*) as entries, {iso_sql('min(ts)')} as first_ts, {iso_sql('max(ts)')} as last_ts
        from logs group by source""")),
    "d9_total_of_table": (d9_total_of_table, with_logs(
        "select count(*) as total from logs where ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00'")),
    "e1_trace_of_table": (e1_trace_of_table, with_logs(f"select {ENTRY_SQL}, source from logs where trace_id = 'trace-41'")),
    "a16_nested_keys": (a16_nested_keys, with_logs("""
        select source, path, type from (select distinct source from logs) s, (values ('meta', 'object'), ('meta.at', 'object'),
          ('meta.at.name', 'string'), ('meta.at.even', 'boolean'), ('meta.tags', 'array'), ('meta.tags[]', 'string'),
          ('parts', 'array'), ('parts[]', 'object'), ('parts[].text', 'string')) v(path, type)
        union all select source, path, type from (select distinct source from logs where source = 'src1') s,
          (values ('only', 'object'), ('only.lvl', 'string'), ('only.id', 'number')) v(path, type)""")),
    "d10_most_frequent": (d10_most_frequent, with_logs(
        "select message, count(*) as count from logs group by message order by count desc, message limit 5")),
}
