"""Sharding by rendezvous hashing: every record goes to the shard that wins its lottery.

For each shard a record key draws a number u in (0, 1) from the MD5 of key and shard number; the shard with the least
-ln(u) / weight wins, so shards get records in proportion to their weights. A shard's draw does not depend on the other
shards: adding one takes records only into it, removing one moves only its own, changing a weight moves records only
to or from that shard. MD5 is the same on every engine and release, so assignments outlive clusters.

`write_shards` writes the records as files of their shards. Records are ranged by shard, key and content, so a hot shard
is written by as many tasks as its bytes ask for and equal keys are split too. A record's slot is its place in its
shard: the number of records in the shard's earlier files, plus its row number in its file. Only file sizes are totalled;
no window sees records. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidelog.llm.common import unused

SHARDS = 8
#: Hexadecimal digits of the MD5 in a draw: 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """-ln(u) of a key's draw for a shard; a null key draws as the empty text."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return -F.log((number + 0.5) / float(16**DIGITS))


def shard_of(key: Column, weights: Sequence[float] = (1.0,) * SHARDS) -> Column:
    """The shard of a key, from 0: the least draw by weight, ties to the smaller number. Shards of weight 0 get nothing."""
    if not any(weights) or any(w < 0 for w in weights):
        raise ValueError("weights are 0 or more, and one of them more than 0")
    tickets = [F.struct((draw(key, i) / float(w)).alias("least"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w]
    return F.array_min(F.array(*tickets))["shard"]


def with_shard(rows: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """Rows with the shard of their key, without a shuffle. Equal keys share a shard; null keys are one key. A column of
    that name is replaced."""
    return rows.withColumn(column, shard_of(F.col(key), weights))


def write_shards(
    rows: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", order: Sequence[str] = ()
) -> None:
    """Writes rows, with all their columns, as Parquet files in a folder `shard=N` per shard.

    Inside a shard rows lie in the order of their key (nulls first) and then of the columns in `order`, which should be
    narrow; rows alike in all of these lie next to each other. Null and empty texts are values like any other. A column
    `shard` of the input is replaced. An empty input makes a folder without rows.
    """
    salt = f"{unused(rows)}salt"
    # The last range key splits rows that are alike in all others.
    placed = with_shard(rows, weights, key).withColumn(salt, F.monotonically_increasing_id())
    keys = ["shard", key, *order, salt]
    ranged = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    ranged.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Written rows with `shard` and `slot`, their place in the shard, gapless from 0. `schema` is that of the rows; a
    column `slot` of theirs is replaced."""
    own = StructType([f for f in schema.fields if f.name.lower() != "shard"] + [StructField("shard", IntegerType())])
    rows = spark.read.schema(own).parquet(path)
    prefix, name = unused(rows), F.col("_metadata.file_name")
    shard, file, row, first = (f"{prefix}{c}" for c in ("shard", "file", "row", "first"))
    counts = rows.groupBy(F.col("shard").alias(shard), name.alias(file)).agg(F.count("*").alias("n"))
    # One row per file. Files are numbered by the range they hold, and by their order in it.
    number = F.regexp_extract(file, r"^part-([0-9]+)", 1).cast("bigint")
    before = Window.partitionBy(shard).orderBy(number, file).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    found = rows.select("*", name.alias(f"{file}_"), F.col("_metadata.row_index").alias(row))
    joint = found.join(counts, (F.col("shard") == F.col(shard)) & (F.col(f"{file}_") == F.col(file)))
    return joint.withColumn("slot", F.col(first) + F.col(row)).select(*[c for c in own.names if c.lower() != "slot"], "slot")
