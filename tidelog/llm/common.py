"""Helpers of the corpus operators: staged tables, row-wise Python in Arrow batches, connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.session import shared_dir

# A Python task holds one batch at a time: bounded rows, and bounded bytes for long texts.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Whether a statement's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the batches that Python tasks hold, lets adaptive execution split hot join keys, and sends this
    package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidelog_sent", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="tidelog-")  # read by the driver only, which serves it to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/tidelog", "zip", root, "tidelog"))
        context._tidelog_sent = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors cost nothing. The shuffle files
    of the write, which nothing reads again, go with its end instead of when the driver collects its garbage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def extend(
    rows: DataFrame,
    inputs: Sequence[str],
    start: Callable[[], Callable[..., list[list]]],
    results: str,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Rows with further columns worked out in Python, one Arrow batch at a time.

    `start` runs once per task and returns a function from the input columns (lists) to the result
    columns (lists). Columns pass through, but for those in `drop`; a column that has the name of a
    result is replaced by it, whatever it held.
    """
    fields = T._parse_datatype_string(results).fields
    gone = {f.name.lower() for f in fields} | {c.lower() for c in drop}
    kept = [f for f in rows.schema.fields if f.name.lower() not in gone]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in [*kept, *fields]]
    places = [i for i, f in enumerate(rows.schema.fields) if f.name.lower() not in gone]
    sources = [[f.name.lower() for f in rows.schema.fields].index(c.lower()) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            found = work(*(batch.column(i).to_pylist() for i in sources))
            new = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *new], names=names)

    return rows.mapInArrow(run, T.StructType([*kept, *fields]))


def unused(rows: DataFrame) -> str:
    """A prefix that no column of the rows has, for columns that go again."""
    prefix = "_"
    while any(c.startswith(prefix) for c in rows.columns):
        prefix += "_"
    return prefix


def components(links: DataFrame, purpose: str = "links") -> DataFrame:
    """(node, component) for links (a, b): component is the smallest node reachable.

    Large-star and small-star rounds on tables in the shared folder. Every round sends each node of a
    path nearer to its smallest one, so the rounds grow with the logarithm of the longest path. Minima
    are combined inside tasks before they move; a node with very many links is a hot join key against
    a single row, which adaptive execution splits. Self links give single nodes, nulls are no links.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    real = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = staged(real.where(F.col("a") != F.col("b")).select(u, v).distinct(), purpose)
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = edges.agg(*mark).first()
    while before.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(rest.unionByName(small.withColumnRenamed("m", "v")).distinct(), purpose)
        now = after.agg(*mark).first()
        discard(edges)
        edges, before, same = after, now, now == before
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
