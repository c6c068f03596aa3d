"""Live windows with a count of the entries that came too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeexpr import micros, parse_width
from ..functions.timestamps import epoch_bucket
from ..operators.aggregate import BUCKET, group_key, metric_name, numeric_field
from .deltas import COMPACT, done, keep_batch, read_folded, run_batches

PARTS = ("count", "numbers", "total", "least", "greatest")
LATE = T.StructType(
    [
        T.StructField("watermark", T.TimestampType()),
        T.StructField("newest", T.TimestampType()),
        T.StructField("entries", T.LongType()),
        T.StructField("late", T.LongType()),
    ]
)


def _schema(group_by) -> T.StructType:
    keys = [T.StructField(BUCKET, T.TimestampType()), *[T.StructField(n, T.StringType()) for n in group_by]]
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    return T.StructType(keys + [T.StructField(n, k) for n, k in zip(PARTS, kinds)])


def _merge(group_by):
    def merge(rows: DataFrame) -> DataFrame:
        folds = [F.sum("count"), F.sum("numbers"), F.sum("total"), F.min("least"), F.max("greatest")]
        return rows.groupBy(BUCKET, *group_by).agg(*[fold.alias(n) for fold, n in zip(folds, PARTS)])

    return merge


def _newest(spark: SparkSession, path: str, batch: int):
    """The newest time of all batches before this one, in microseconds: a row that the last of them wrote."""
    if not batch:
        return None
    return spark.read.schema(LATE).parquet(f"{path}/late/batch={batch - 1}").select(F.unix_micros("newest")).first()[0]


def follow_windows(
    stream: DataFrame, path: str, group_by=(), width: str = "5m", lateness: str = "10m", field: str | None = None,
    compact: int = COMPACT, **trigger,
) -> StreamingQuery:
    """Starts counting entries per fixed-width bin and key; entries that are too late are left out and counted.

    An entry is too late when its bin ended at or before the watermark: the newest time of all earlier batches, less
    `lateness`. This is the rule of Spark's watermarks, which count groups of late rows instead of rows. Entries without
    a time take no part. The state is a table of sums, so any batch can be repeated.
    """
    path, size = path.rstrip("/"), micros(parse_width(width))
    slack = micros(parse_width(lateness))
    number = numeric_field(field) if field else F.lit(None).cast("double")
    names = _schema(group_by).names

    def keep(logs: DataFrame, batch: int) -> None:
        spark = logs.sparkSession
        newest = F.timestamp_micros(F.lit(_newest(spark, path, batch)).cast("bigint"))
        watermark = F.timestamp_micros(F.unix_micros(newest) - slack)
        timed = logs.where(F.col("ts").isNotNull()).withColumn(BUCKET, epoch_bucket(F.col("ts"), parse_width(width)))
        late = F.coalesce(F.unix_micros(BUCKET) + size <= F.unix_micros(watermark), F.lit(False))
        keys = [F.col(BUCKET), *[group_key(n).alias(n) for n in group_by]]
        folds = [F.count("*"), F.count(number), F.sum(number), F.min(number), F.max(number)]
        sums = timed.where(~late).groupBy(*keys).agg(*[fold.alias(n) for fold, n in zip(folds, PARTS)])
        keep_batch(sums.select(*names), path, batch, _merge(group_by), compact)
        newest = F.greatest(F.max("ts"), newest)
        seen = timed.agg(newest.alias("newest"), F.count("*").alias("entries"), F.count_if(late).alias("late"))
        seen = seen.withColumn("watermark", watermark).select(*LATE.names)
        seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")

    return run_batches(stream, path, keep, **trigger)


def live_windows(spark: SparkSession, path: str, group_by=(), metric: str = "count") -> DataFrame:
    """All bins so far, also those still open: key, value and count, as `follow_aggregate` names them."""
    sums = read_folded(spark, path.rstrip("/"), _schema(group_by), _merge(group_by))
    value = {"count": F.col("count").cast("double"), "sum": F.col("total"), "min": F.col("least"), "max": F.col("greatest"),
             "avg": F.col("total") / F.nullif(F.col("numbers"), F.lit(0))}[metric_name(metric)]
    return sums.select(BUCKET, *group_by, F.coalesce(value, F.lit(0.0)).alias("value"), "count")


def late_entries(spark: SparkSession, path: str) -> DataFrame:
    """(batch, watermark, newest, entries, late) of every finished batch."""
    path = path.rstrip("/")
    last = done(spark, path)
    schema = T.StructType([*LATE.fields, T.StructField("batch", T.IntegerType())])
    if last < 0:
        return spark.createDataFrame([], schema).select("batch", *LATE.names)
    rows = spark.read.schema(schema).parquet(f"{path}/late")
    return rows.where(F.col("batch") <= last).select("batch", *LATE.names)
