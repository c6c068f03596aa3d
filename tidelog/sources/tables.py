"""The normalised log table: written once, partitioned by source and day, read by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..schema import COLUMNS, LOG_SCHEMA
from ..session import shared_dir

PARTITIONS = ("source", "dt")


def line_offsets(staged: DataFrame) -> DataFrame:
    """First line number of every file block, files in path order.

    A running total without one big sort: blocks are range-partitioned by (source, path, start)
    and written, each part is summed, and only the sums of the parts are totalled in one place.
    The range number is written with the rows, so both readers see the same parts.
    """
    spark = staged.sparkSession
    keys = ["source", "file_path", "block_start"]
    blocks = staged.groupBy(*keys).agg(
        F.min("line_pos").alias("first_pos"),
        (F.max("line_pos") - F.min("line_pos") + 1).alias("lines"),
    )
    # Paths are ordered part by part: the separator comes before any other character.
    blocks = blocks.withColumn("path_parts", F.translate("file_path", "/", "\u0000"))
    order = ["source", "path_parts", "block_start"]
    folder = shared_dir(spark, "blocks")
    ranged = blocks.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged.write.parquet(folder)
    blocks = spark.read.parquet(folder)
    parts = blocks.groupBy("part").agg(F.sum("lines").alias("lines"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    # One row per part of the range partitioning.
    parts = parts.select(
        "part",
        F.coalesce(F.sum("lines").over(before.orderBy("part")), F.lit(0)).alias("part_base"),
    )
    inside = F.coalesce(
        F.sum("lines").over(before.partitionBy("part").orderBy(*order)), F.lit(0)
    )
    return (
        blocks.withColumn("inside", inside)
        .join(parts, "part")
        .select(*keys, "first_pos", (F.col("part_base") + F.col("inside")).alias("base"))
    )


def with_final_seq(staged: DataFrame) -> DataFrame:
    """`seq` as the line number over all files in path order; position columns are dropped.

    `staged` must be a written table: the positions of a text scan are only fixed once stored.
    A block holds at most one split of one file, so the join has no hot key.
    """
    keys = ["source", "file_path", "block_start"]
    numbered = staged.drop("seq").join(line_offsets(staged), keys)
    seq = F.col("base") + F.col("line_pos") - F.col("first_pos")
    return numbered.withColumn("seq", seq).select(*COLUMNS)


def with_day(entries: DataFrame) -> DataFrame:
    """Entries with `dt`, the UTC day in any session."""
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("int")
    return entries.withColumn("dt", F.date_add(F.lit("1970-01-01").cast("date"), day))


def write_log_table(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write entries as Parquet under source=/dt=, sorted by time inside each file.

    Entries read from files are staged first, which parses each line once, and get their final
    `seq`; the staged copy goes after the write. An append goes on behind the greatest `seq` of each source,
    so `seq` stays unique over loads. `dt` is the UTC day in any session. Rows are ranged by (source, day, time, seq), so a source or day with most of the rows
    is spread over many tasks. Trace ids get Bloom filters, by which a scan for one trace passes over most row groups.
    """
    spark = entries.sparkSession
    staging = shared_dir(spark, "staging") if "line_pos" in entries.columns else None
    if staging:
        entries.write.parquet(staging)
        entries = with_final_seq(spark.read.parquet(staging))
    files, folder = folder_of(spark, path)
    if mode == "append" and files.exists(folder):
        last = read_log_table(spark, path).groupBy("source").agg((F.max("seq") + 1).alias("seq_base"))
        seq = F.col("seq") + F.coalesce("seq_base", F.lit(0))
        entries = entries.join(last, "source", "left").withColumn("seq", seq).drop("seq_base")
    (
        with_day(entries).repartitionByRange("source", "dt", "ts", "seq")
        .sortWithinPartitions("source", "dt", "ts", "seq")
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .parquet(path)
    )
    if staging:
        files, folder = folder_of(spark, staging)
        files.delete(folder, True)


def folder_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with its `dt` column, by which time ranges prune folders."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("dt", T.DateType())])
    return spark.read.schema(schema).parquet(path)
