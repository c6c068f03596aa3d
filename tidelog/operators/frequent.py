"""The most frequent values of a column, exactly, without moving every distinct value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Values that the summary tracks.
TRACKED = 10_000
# The summary's own bound, in rows for each row that it saw and value that it tracks: what it does not give has no more.
MISSED = 2 * 3.5 * 0.75
#: Candidates that are counted again for each value that is asked for.
SPARE = 20


def most_frequent(df: DataFrame, column: str, n: int, tracked: int = TRACKED) -> DataFrame:
    """(column, count) of the `n` most frequent values, ties by the value; nulls are no value.

    A mergeable summary of every task's values proposes candidates, which are then counted exactly; values that are not
    candidates have at most the summary's error of rows. Where the `n`-th candidate has more, the result is exact and only
    candidates were shuffled. Where it has not, as when all values are about equally rare, all values are counted.
    """
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    found = values.agg(F.expr(f"approx_top_k(value, {min(n * SPARE, tracked)}, {tracked})").alias("top"), F.count("*").alias("rows")).first()
    candidates = [item["item"] for item in found["top"] or []]
    if candidates:
        kind = df.schema[column].dataType.simpleString()
        listed = df.sparkSession.createDataFrame([(c,) for c in candidates], f"value {kind}")
        # As many rows as candidates: n * SPARE at most.
        counts = values.join(F.broadcast(listed), "value", "left_semi").groupBy("value").agg(F.count("*").alias("count"))
        top = counts.orderBy(F.desc("count"), "value").limit(n).collect()
        # A candidate list that was not full has every value the summary could tell.
        bound = MISSED * found["rows"] / tracked
        if len(candidates) == min(n * SPARE, tracked):
            bound = max(bound, min(item["count"] for item in found["top"]))
        if len(top) == n and top[-1]["count"] > bound:
            schema = f"value {kind}, count bigint"
            return df.sparkSession.createDataFrame([tuple(r) for r in top], schema).withColumnRenamed("value", column)
    every = values.groupBy("value").agg(F.count("*").alias("count"))
    return every.orderBy(F.desc("count"), "value").limit(n).withColumnRenamed("value", column)
