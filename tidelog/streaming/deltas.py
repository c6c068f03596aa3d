"""Tables that a stream keeps up to date: one folder per micro-batch, folded when read.

A batch writes its rows into a folder of its own number and replaces what an earlier, failed try of the same batch left
there, so a batch that is repeated adds nothing. Readers see the batches that the stream's progress log names as done.
Every COMPACT batches all folders so far are folded into one sum, and what the sum before it covered goes.

Layout: `batches/batch=N`, `sums/sum=N` (all batches up to N folded), `_progress` (Spark's own log).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..sources.tables import folder_of

COMPACT = 50

Merge = Callable[[DataFrame], DataFrame]


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """The numbers that the entries of a folder are named by, rising."""
    files, place = folder_of(spark, folder)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def done(spark: SparkSession, path: str) -> int:
    """The last batch that the stream of a table has finished, -1 before the first."""
    return max(_numbers(spark, f"{path}/_progress/commits"), default=-1)


def keep_batch(rows: DataFrame, path: str, batch: int, merge: Merge, compact: int = COMPACT) -> None:
    """Writes the rows of a batch, in place of those of an earlier try."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")
    if (batch + 1) % compact:
        return
    older = [n for n in _numbers(spark, f"{path}/sums", "sum=") if n < batch]
    whole = read_folded(spark, path, rows.schema, merge, batch)
    whole.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/sums/sum={batch}")
    if older:  # readers may still use the sum before this one, and the batches behind it
        files, _ = folder_of(spark, path)
        covered = [f"{path}/batches/batch={n}" for n in _numbers(spark, f"{path}/batches", "batch=") if n <= older[-1]]
        for folder in covered + [f"{path}/sums/sum={n}" for n in older[:-1]]:
            files.delete(folder_of(spark, folder)[1], True)


def read_folded(spark: SparkSession, path: str, schema: T.StructType, merge: Merge, last: int | None = None) -> DataFrame:
    """The table after the stream's last finished batch (or the given one): `merge` makes the rows of one key, which have
    a further column `batch`, one row."""
    last = done(spark, path) if last is None else last
    start = max((n for n in _numbers(spark, f"{path}/sums", "sum=") if n <= last), default=-1)
    own = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    parts = [spark.createDataFrame([], own)]
    if start >= 0:
        parts.append(spark.read.schema(own).parquet(f"{path}/sums/sum={start}"))
    if any(start < n <= last for n in _numbers(spark, f"{path}/batches", "batch=")):
        batches = spark.read.schema(own).parquet(f"{path}/batches")
        parts.append(batches.where((F.col("batch") > start) & (F.col("batch") <= last)))
    return merge(reduce(DataFrame.unionByName, parts)).select(*schema.names)


def latest(keys) -> Merge:
    """Of the rows of each key, the one of the last batch."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
        return last.select(*keys, "last.*")

    return merge


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append", **trigger):
    """Starts a stream that hands its batches to `each` and keeps its progress under `path`; by default it ends with
    the input there is."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_progress")
    return writer.foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def run_to_latest(stream: DataFrame, path: str, keys, compact: int = COMPACT) -> DataFrame:
    """All present input of a stream of changing results, such as windows that are still open, as a table of the last
    version of each. Null keys are keys. Another run into the same path goes on where the last one ended."""
    path, merge = path.rstrip("/"), latest(keys)
    run_batches(stream, path, lambda rows, batch: keep_batch(rows, path, batch, merge, compact), "update").awaitTermination()
    return read_folded(stream.sparkSession, path, stream.schema, merge)
