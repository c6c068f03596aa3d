"""The one record layout every source is mapped to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("search_text", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

COLUMNS = tuple(LOG_SCHEMA.names)

# Where a line came from; kept next to the log columns until `seq` is final.
POSITION_COLUMNS = ("file_path", "block_start", "line_pos")

UNKNOWN_LEVEL = "UNKNOWN"
UNKNOWN = "unknown"

# Levels counted as trouble by the correlation score, the period comparison and the error rate.
ALARM_LEVELS = ("ERROR", "WARN", "WARNING")
WARNING_LEVELS = ("WARN", "WARNING")

SEARCH_SEPARATOR = "\u0001"


def is_alarm(level="level"):
    return F.col(level).isin(*ALARM_LEVELS)


def conform(df: DataFrame) -> DataFrame:
    """Log columns in schema order, null where `df` lacks one; position columns are kept."""
    have = set(df.columns)
    picked = [
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        for f in LOG_SCHEMA
    ]
    picked = [c.alias(n) for c, n in zip(picked, COLUMNS)]
    return df.select(*picked, *[c for c in POSITION_COLUMNS if c in have])
