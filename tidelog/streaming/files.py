"""Live log files: folders of files as a stream into the log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import COLUMNS, LOG_SCHEMA
from ..session import shared_dir
from ..sources.lines import LineOptions, parse_lines, stream_raw_lines, with_positions
from ..sources.tables import folder_of, with_day, with_final_seq
from .deltas import done, run_batches


def _ends(spark: SparkSession, path: str, batch: int) -> int:
    """The number that the batch's first line gets: one row, written by the batch before it."""
    return spark.read.parquet(f"{path}/_ends/batch={batch - 1}").first()[0] if batch else 0


def follow_files(
    spark: SparkSession,
    paths,
    source: str,
    path: str,
    json: bool = True,
    pattern: str | None = None,
    opts: LineOptions = LineOptions(),
    files_per_batch: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Starts reading the files matching `paths`, and those that come later, into the live log table at `path`.

    Lines are read and parsed as `read_log_lines` and `parse_lines` do. Every batch becomes a folder
    `source=S/batch=N/dt=D`, which a repeated batch replaces. `seq` is the line number: within a batch files are in
    path order, and each batch goes on behind the last one. A file is read once, when first seen. By default the query
    ends with the files there are; `trigger` takes Spark's triggers. Sources have progress logs of their own, so
    several may feed one table; a source's next run goes on where the last one ended.
    """
    path = path.rstrip("/")
    own = f"{path}/source={source}"

    def keep(raw: DataFrame, batch: int) -> None:
        entries = parse_lines(with_positions(raw, source), json, pattern, opts)
        staging = shared_dir(spark, "staging")
        entries.write.parquet(staging)  # parsed once; positions are only fixed once stored
        staged = spark.read.schema(entries.schema).parquet(staging)
        first = _ends(spark, own, batch)
        final = with_day(with_final_seq(staged).withColumn("seq", F.col("seq") + first))
        ranged = final.drop("source").repartitionByRange("dt", "ts", "seq").sortWithinPartitions("dt", "ts", "seq")
        ranged.write.mode("overwrite").partitionBy("dt").parquet(f"{own}/batch={batch}")
        written = spark.read.schema("seq bigint").parquet(f"{own}/batch={batch}")
        after = written.agg(F.coalesce(F.max("seq") + 1, F.lit(first)).alias("end"))
        after.write.mode("overwrite").parquet(f"{own}/_ends/batch={batch}")
        files, place = folder_of(spark, staging)
        files.delete(place, True)

    return run_batches(stream_raw_lines(spark, paths, files_per_batch), own, keep, **trigger)


def read_live_table(spark: SparkSession, path: str) -> DataFrame:
    """The log table, with `dt`, of the batches that are done. A batch that a failure cut short is not seen."""
    path = path.rstrip("/")
    files, place = folder_of(spark, path)
    sources = []
    if files.exists(place):
        names = [status.getPath().getName() for status in files.listStatus(place)]
        sources = sorted(n.removeprefix("source=") for n in names if n.startswith("source="))
    extra = [T.StructField("dt", T.DateType()), T.StructField("batch", T.IntegerType())]
    schema = T.StructType([*LOG_SCHEMA.fields, *extra])
    finished = {source: done(spark, f"{path}/source={source}") for source in sources}
    if not any(last >= 0 for last in finished.values()):
        return spark.createDataFrame([], schema).drop("batch")
    seen = F.lit(False)
    for source, last in finished.items():
        seen = seen | ((F.col("source") == source) & (F.col("batch") <= last))
    return spark.read.schema(schema).parquet(path).where(seen).select(*COLUMNS, "dt")
