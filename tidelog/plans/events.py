"""The `events` table as logs, in Spark and as the same view in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timestamps import iso_text
from ..schema import SEARCH_SEPARATOR, conform
from ..session import configure
from ..sources.tables import folder_of

# The files hold times without a zone; read as TIMESTAMP they are the same instants in UTC.
EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = configure(spark).read
    if name == "events":
        reader = reader.schema(EVENTS_SCHEMA)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; a table of one file is found by its name."""
    reader = configure(spark).readStream.schema(EVENTS_SCHEMA)
    path = f"{sf_dir}/events.parquet"
    files, place = folder_of(spark, path)
    if files.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def as_logs(events: DataFrame) -> DataFrame:
    """Events in the log layout, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    user, kind = F.col("user_id"), F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind == "signup", "WARNING")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
    )
    failure = (
        F.when(F.col("k") % 4 == 0, "connection timeout")
        .when(F.col("k") % 4 == 1, "database unavailable")
        .when(F.col("k") % 4 == 2, "connection refused")
        .otherwise("payload rejected")
    )
    status = (F.col("k") % 20).cast("string")
    named = events.withColumn("k", k).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source"),
        "ts",
        iso_text(F.col("ts")).alias("ts_raw"),
        level.alias("level"),
        F.when(kind == "error", F.concat(failure, F.lit(" code "), status))
        .otherwise(F.concat(kind, F.lit(" ok status "), status))
        .alias("message"),
        F.when(user % 10 != 9, F.concat(F.lit("svc"), (user % 5).cast("string"))).alias("service"),
        F.concat(F.lit("host"), (user % 7).cast("string")).alias("host"),
        F.concat(F.lit("trace-"), F.call_function("div", F.col("event_id"), F.lit(5)).cast("string")).alias("trace_id"),
        F.create_map(
            F.lit("k"), F.col("k").cast("string"),
            F.lit("value"), F.col("value").cast("string"),
            F.lit("event_type"), kind,
        ).alias("fields"),
        "event_type",
    )
    text = F.lower(F.concat_ws(SEARCH_SEPARATOR, "message", "service", "host", "event_type"))
    return conform(named.withColumn("search_text", text))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"))


def iso_sql(ts: str) -> str:
    """SQL for the ISO text of a timestamp column."""
    return (
        f"case when epoch_us({ts}) % 1000000 = 0 then strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
        f"else strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') end"
    )


LOGS_SQL = f"""
logs as (
  select event_id as seq, concat('src', event_id % 3) as source, ts, {iso_sql('ts')} as ts_raw,
    case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'WARNING'
                    when 'view' then 'DEBUG' else 'INFO' end as level,
    case when event_type = 'error' then concat(case k % 4 when 0 then 'connection timeout'
           when 1 then 'database unavailable' when 2 then 'connection refused'
           else 'payload rejected' end, ' code ', k % 20)
         else concat(event_type, ' ok status ', k % 20) end as message,
    case when user_id % 10 = 9 then null else concat('svc', user_id % 5) end as service,
    concat('host', user_id % 7) as host,
    concat('trace-', event_id // 5) as trace_id,
    k, value, event_type
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) e
)"""


def with_logs(query: str, *more: str) -> str:
    """A SQL text that can use the view `logs` and the given further views."""
    return "with " + ", ".join([LOGS_SQL.strip(), *more]) + "\n" + query
