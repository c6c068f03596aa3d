"""Side tables of a log table: the same rows as the plain forms, and fewer files opened."""

from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidelog import sources as src
from tidelog.functions.timeexpr import TimeRange
from tidelog.operators import frequent, ordering
from tidelog.operators.correlate import correlate_trace
from tidelog.operators.predicates import in_time_range, search
from tidelog.schema import conform
from tidelog.session import shared_dir
from tidelog.sources import zones

FILES = 40


def entries(spark, n):
    """Entries of which every file of 25 holds one rare word."""
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "a b").otherwise("c%d").alias("source"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"),
        F.when(F.col("id") % 100 == 7, "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("usual words "), F.when(F.col("id") % 500 == 3, F.concat(F.lit("Zebra"), F.col("id").cast("string"))).otherwise("only")).alias("message"),
        F.concat(F.lit("trace-"), F.call_function("div", F.col("id"), F.lit(5)).cast("string")).alias("trace_id"),
    )
    return conform(rows.withColumn("search_text", F.lower("message")))


@pytest.fixture(scope="module")
def table(spark):
    path = shared_dir(spark, "zoned")
    every = src.tables.with_day(entries(spark, 2000)).repartitionByRange(FILES, "seq").sortWithinPartitions("seq")
    every.write.partitionBy("source").parquet(path)
    zones.update_zones(spark, path)
    zones.update_trigrams(spark, path)
    return path


def plain(spark, path):
    return spark.read.schema(zones._schema()).parquet(path)


def opened(df):
    """The number of files that a plan's scans read."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.metrics().contains("numFiles"):
                found += node.metrics().apply("numFiles").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def rows(df):
    return [(r.seq, r.source, r.message) for r in df.collect()]


def test_zones_hold_every_file_once(spark, table):
    found = zones.read_zones(spark, table)
    assert found.agg(F.sum("n")).first()[0] == 2000 and found.count() == 2 * FILES
    zones.update_zones(spark, table)
    assert zones.read_zones(spark, table).count() == 2 * FILES


def test_tail(spark, table):
    got = zones.tail_of_table(spark, table, 50)
    assert rows(got) == rows(ordering.tail(plain(spark, table), 50))
    assert opened(zones.tail_of_table(spark, table, 50)) <= 4
    for query, lines in (("zebra", 2), ("zebra", 50), ("no such text", 5)):
        assert rows(zones.tail_of_table(spark, table, lines, query)) == rows(ordering.tail(plain(spark, table), lines, query))


def test_pages(spark, table):
    for limit, offset in ((20, 0), (20, 990), (50, 1980), (10, 5000)):
        assert rows(zones.page_of_table(spark, table, limit, offset)) == rows(ordering.first_matches(plain(spark, table), limit, offset))
    assert opened(zones.page_of_table(spark, table, 20, 1000)) <= 8
    for offset in (0, 2):
        want = ordering.first_matches(search(plain(spark, table), "zebra"), 2, offset)
        assert rows(zones.page_of_table(spark, table, 2, offset, "zebra")) == rows(want)


def test_entries_without_numbers_and_times(spark):
    path = shared_dir(spark, "zoned")
    odd = entries(spark, 90).withColumn("seq", F.when(F.col("seq") % 3 > 0, F.col("seq"))).withColumn("ts", F.when(F.col("seq") % 2 == 0, F.col("ts")))
    for part in range(2):
        src.tables.with_day(odd).where(F.length("message") % 2 == part).write.mode("append").partitionBy("source", "dt").parquet(path)
        zones.update_zones(spark, path)
    assert sorted(rows(zones.page_of_table(spark, path, 90, 0)), key=str) == sorted(rows(plain(spark, path)), key=str)
    assert rows(zones.tail_of_table(spark, path, 7)) == rows(ordering.tail(plain(spark, path), 7))
    tr = TimeRange.of("2023-11-14T22:20:00Z", "2023-11-14T23:00:00Z")
    assert zones.total_of_table(spark, path, tr) == in_time_range(plain(spark, path), tr).count()
    assert zones.total_of_table(spark, path) == 90


def test_sources_and_totals(spark, table):
    got = {tuple(r) for r in zones.sources_of_table(spark, table).collect()}
    assert got == {tuple(r) for r in src.list_sources(plain(spark, table)).collect()}
    tr = TimeRange.of("2023-11-15T00:00:00Z", "2023-11-15T12:34:56Z")
    assert zones.total_of_table(spark, table, tr) == in_time_range(plain(spark, table), tr).count()


def test_search_opens_few_files(spark, table):
    for query in ("Zebra1503", "zebra", "ERROR", "error", "usual WORDS", "xyz", "eb", ""):
        got = zones.search_table(spark, table, query)
        assert sorted(rows(got)) == sorted(rows(search(plain(spark, table), query))), query
    assert zones.files_with(spark, table, "zebra1503").count() <= 0.1 * 2 * FILES
    assert zones.files_with(spark, table, "usual").count() == 2 * FILES


def test_empty_table(spark):
    path = shared_dir(spark, "zoned")
    src.write_log_table(entries(spark, 0), path)
    zones.update_zones(spark, path)
    zones.update_trigrams(spark, path)
    assert zones.tail_of_table(spark, path).count() == zones.page_of_table(spark, path, 5).count() == zones.total_of_table(spark, path) == 0
    assert zones.search_table(spark, path, "zebra").count() == 0


def test_traces_pass_over_row_groups(spark):
    path = shared_dir(spark, "traced")
    spark.conf.set("parquet.block.size", 4096)
    try:
        mixed = entries(spark, 4000).withColumn("trace_id", F.concat(F.lit("t"), F.abs(F.xxhash64("seq")).cast("string")))
        src.write_log_table(mixed, path)
    finally:
        spark.conf.unset("parquet.block.size")
    table = src.read_log_table(spark, path)
    one = mixed.where("seq = 1234").first().trace_id
    found = correlate_trace(table, one)
    assert [r.seq for r in found.collect()] == [1234]
    footer = unquote(table.inputFiles()[0])
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(footer), spark._jsc.hadoopConfiguration())
    with_filter = reader.open(source).getFooter().getBlocks().get(0).getColumns()
    offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in (with_filter.get(i) for i in range(with_filter.size()))}
    assert offsets["trace_id"] > 0 and offsets["message"] < 0


def test_most_frequent_values(spark):
    usual = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, F.concat(F.lit("m"), (F.col("id") % 6).cast("string"))).otherwise(F.concat(F.lit("rare"), F.col("id").cast("string"))).alias("v"))
    want = [tuple(r) for r in usual.groupBy("v").count().orderBy(F.desc("count"), "v").limit(5).collect()]
    assert [tuple(r) for r in frequent.most_frequent(usual, "v", 5).collect()] == want
    # All equally rare: the candidates cannot be told from the rest.
    flat = spark.range(3000).select(F.concat(F.lit("x"), (F.col("id") % 1500).cast("string")).alias("v"))
    want = [tuple(r) for r in flat.groupBy("v").count().orderBy(F.desc("count"), "v").limit(5).collect()]
    assert [tuple(r) for r in frequent.most_frequent(flat, "v", 5, tracked=100).collect()] == want
    assert frequent.most_frequent(flat.where("v is null"), "v", 5).count() == 0


def test_bitmaps_are_made_of_different_bits(spark, table, capsys, monkeypatch):
    """The rows that a bitmap's aggregate sorts are bounded by the bits, not by the entries."""
    folds = []
    monkeypatch.setattr(zones, "_update", lambda spark, path, name, schema, fold: folds.append(fold))
    zones.update_trigrams(spark, table)
    rows = plain(spark, table).withColumn("file", F.col("source"))
    folds[0](rows).explain()
    plan = capsys.readouterr().out.splitlines()
    bitmap = max(i for i, line in enumerate(plan) if "bitmap_construct_agg" in line)
    assert any("HashAggregate(keys=[file" in line and "functions=[]" in line for line in plan[bitmap + 1 :])
