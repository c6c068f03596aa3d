"""Side tables of a log table: what each of its files holds, so that queries open only the files they need.

`_zones` has one row per file: source, day, entries, and the least and greatest `seq` and time. `_trigrams` has, per file, the
set of three-letter pieces of its search text, as a bitmap of hashes. Both lie in the table's folder, where Spark's readers
pass over them, and are brought up to date by reading the files that are not in them yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from ..functions.timeexpr import TimeRange
from ..operators.ordering import first_matches, tail
from ..operators.predicates import in_time_range, search
from ..schema import LOG_SCHEMA, SEARCH_SEPARATOR
from .lines import decoded_path, qualified_path
from .tables import folder_of, read_log_table

ZONES = "file string, source string, dt date, n bigint, untimed bigint, min_seq bigint, max_seq bigint, min_ts timestamp, max_ts timestamp"
TRIGRAMS = "file string, signature binary"
LEAST_SEQ = -(2**63)
# Bits of a signature: fixed by Spark's bitmap functions.
BITS = 32_768
#: A search that needs more entries than a range of files has takes this many times as many next.
GROWTH = 8


def _schema() -> T.StructType:
    return T.StructType([*LOG_SCHEMA.fields, T.StructField("dt", T.DateType())])


def _file(spark: SparkSession, path: str) -> Column:
    """The name of an entry's file, below the table's folder."""
    root = qualified_path(spark, path.rstrip("/"))
    return F.substring(decoded_path(F.col("_metadata.file_path")), F.lit(len(root) + 2), F.lit(1 << 30))


def _side(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    files, place = folder_of(spark, f"{path}/{name}")
    if not files.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def open_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The entries of some files of the table."""
    if not names:
        return spark.createDataFrame([], _schema())
    reader = spark.read.schema(_schema()).option("basePath", path)
    return reader.parquet(*[f"{path}/{_escaped(name)}" for name in names])


def _escaped(name: str) -> str:
    """A file's name as a path pattern that stands for itself alone."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in name)


def _update(spark: SparkSession, path: str, name: str, schema: str, fold) -> None:
    table = spark.read.schema(_schema()).parquet(path)
    root = len(qualified_path(spark, path)) + 1
    listed = spark.createDataFrame([(f,) for f in table.inputFiles()], "file string")
    have = [r.file for r in _side(spark, path, name, schema).select("file").collect()]
    every = [r[0][root:] for r in listed.select(decoded_path(F.col("file"))).collect()]
    new = sorted(set(every) - set(have))
    if new:
        fold(open_files(spark, path, new).withColumn("file", _file(spark, path))).write.mode("append").parquet(f"{path}/{name}")


def update_zones(spark: SparkSession, path: str) -> None:
    """Adds the table's new files to `_zones`; only `seq` and the time are read."""

    def fold(rows: DataFrame) -> DataFrame:
        # An entry without a number stands before all others.
        seq = F.coalesce("seq", F.lit(LEAST_SEQ))
        return rows.groupBy("file").agg(
            F.first("source").alias("source"), F.first("dt").alias("dt"), F.count("*").alias("n"),
            F.count_if(F.col("ts").isNull()).alias("untimed"), F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"),
            F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        )

    _update(spark, path.rstrip("/"), "_zones", ZONES, fold)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return _side(spark, path.rstrip("/"), "_zones", ZONES)


def _names(files: DataFrame) -> list[str]:
    return [r.file for r in files.select("file").collect()]


def _newest(zones: DataFrame, n: int) -> tuple[list[str], int | None]:
    """The files that hold the last `n` entries, and the number from which on they are all there; None for all files."""
    # One row per file.
    newer = F.sum("n").over(W.orderBy(F.col("min_seq").desc()).rangeBetween(W.unboundedPreceding, W.currentRow))
    first = zones.withColumn("newer", newer).where(F.col("newer") >= n).agg(F.max("min_seq")).first()[0]
    return _names(zones if first is None else zones.where(F.col("max_seq") >= first)), first


def tail_of_table(spark: SparkSession, path: str, lines: int = 50, query: str | None = None) -> DataFrame:
    """`tail` of a table with zones, opening only the files that hold the last entries.

    With a query the newest files are searched first, then GROWTH times as many entries, until enough match.
    """
    zones, wanted = read_zones(spark, path), lines
    while True:
        names, first = _newest(zones, wanted)
        found = open_files(spark, path, names)
        if first is None or not query:
            return tail(found, lines, query)
        if search(found, query).where(F.col("seq") >= first).limit(lines).count() >= lines:
            return tail(found, lines, query)
        wanted *= GROWTH


def page_of_table(spark: SparkSession, path: str, limit: int, offset: int = 0, query: str | None = None) -> DataFrame:
    """`first_matches` of a table with zones, opening only the files that hold the page.

    Files are cut where all numbers on one side are below those on the other. Without a query the entries before the
    page are counted from the zones; with one the first files are searched, then GROWTH times as many entries.
    """
    zones = read_zones(spark, path)
    along = W.orderBy("min_seq", "max_seq").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    cut = zones.withColumns({"reached": F.max("max_seq").over(along), "before": F.coalesce(F.sum("n").over(along), F.lit(0))})
    cut = cut.withColumn("clean", F.col("reached").isNull() | (F.col("reached") < F.col("min_seq")))

    def files(first: int, last: int) -> tuple[list[str], int, bool]:
        """Files with the entries number `first` to before `last`, the entries before them, whether none come after."""
        clean = F.col("clean")
        start, skipped, end = cut.agg(
            F.max(F.when(clean & (F.col("before") <= first), F.col("min_seq"))),
            F.coalesce(F.max(F.when(clean & (F.col("before") <= first), F.col("before"))), F.lit(0)),
            F.min(F.when(clean & (F.col("before") >= last), F.col("min_seq"))),
        ).first()
        held = zones if start is None else zones.where(F.col("min_seq") >= start)
        held = held if end is None else held.where(F.col("max_seq") < end)
        return _names(held), skipped, end is None

    if not query:
        names, skipped, _ = files(offset, offset + limit)
        return first_matches(open_files(spark, path, names), limit, offset - skipped)
    wanted = offset + limit
    while True:
        names, _, whole = files(0, wanted)
        found = search(open_files(spark, path, names), query)
        if whole or found.limit(offset + limit).count() >= offset + limit:
            return first_matches(found, limit, offset)
        wanted *= GROWTH


def sources_of_table(spark: SparkSession, path: str) -> DataFrame:
    """`list_sources` of a table with zones, without opening one of its files."""
    return read_zones(spark, path).groupBy("source").agg(
        F.sum("n").alias("entries"), F.min("min_ts").alias("first_ts"), F.max("max_ts").alias("last_ts")
    )


def total_of_table(spark: SparkSession, path: str, tr: TimeRange | None = None) -> int:
    """The entries in a time range: files within it are counted from the zones, only those across its ends are opened."""
    zones = read_zones(spark, path)
    inside, outside = F.lit(True), F.lit(False)
    if tr is not None and tr.start is not None:
        inside, outside = inside & (F.col("min_ts") >= F.lit(tr.start)), outside | (F.col("max_ts") < F.lit(tr.start))
    if tr is not None and tr.end is not None:
        inside, outside = inside & (F.col("max_ts") <= F.lit(tr.end)), outside | (F.col("min_ts") > F.lit(tr.end))
    # Entries without a time are in every range.
    whole = inside | F.col("min_ts").isNull()
    judged = zones.select("file", "n", "untimed", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(outside, F.lit(False)).alias("outside"))
    counted = F.when(F.col("whole"), F.col("n")).when(F.col("outside"), F.col("untimed")).otherwise(0)
    known = judged.agg(F.coalesce(F.sum(counted), F.lit(0))).first()[0]
    across = _names(judged.where(~F.col("whole") & ~F.col("outside")))
    return known + (in_time_range(open_files(spark, path, across), tr).count() if across else 0)


def _bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS))


def update_trigrams(spark: SparkSession, path: str) -> None:
    """Adds the table's new files to `_trigrams`; only the search text and the level are read."""

    def fold(rows: DataFrame) -> DataFrame:
        text = F.concat_ws(SEARCH_SEPARATOR, "search_text", F.lower("level"))
        pieces = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))
        bits = rows.select("file", F.explode_outer(pieces).alias("piece")).select("file", _bit(F.col("piece")).alias("bit"))
        # Bitmaps are made of sorted rows: a file's different bits, of which there are BITS at most, not all its pieces.
        bits = bits.distinct()
        return bits.groupBy("file").agg(F.bitmap_construct_agg("bit").alias("signature"))

    _update(spark, path.rstrip("/"), "_trigrams", TRIGRAMS, fold)


def files_with(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(file) of the files that may hold a text in lower case; a text under three letters may be in all."""
    kept = _side(spark, path.rstrip("/"), "_trigrams", TRIGRAMS)
    for i in range(len(text) - 2):
        bit = _bit(F.lit(text[i : i + 3]))
        byte = F.conv(F.hex(F.substring("signature", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        kept = kept.where(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1)
    return kept.select("file")


def search_table(spark: SparkSession, path: str, query: str, tr: TimeRange | None = None) -> DataFrame:
    """`search` of a table with trigrams, opening only the files that may hold the query."""
    if len(query) < 3:
        return search(read_log_table(spark, path), query, tr)
    return search(open_files(spark, path, _names(files_with(spark, path, query.lower()))), query, tr)
