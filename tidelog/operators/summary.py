"""What a set of entries is about: histograms, top messages and one sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.timeexpr import TimeRange
from ..schema import UNKNOWN
from .predicates import search

TOP_MESSAGES = 5

NOTHING_FOUND = "No logs found matching the criteria."


def histograms(logs: DataFrame, query: str = "", tr: TimeRange | None = None) -> DataFrame:
    """Counts per level, per service, per message and in total: kind, key, count.

    Grouping sets over one scan; every task combines its counts before the one shuffle, so a key
    that holds most of the rows travels as one row per task.
    """
    named = search(logs, query, tr).select(
        "level", F.coalesce("service", F.lit(UNKNOWN)).alias("service"), "message"
    )
    columns = ["level", "service", "message"]
    counted = named.groupingSets([["level"], ["service"], ["message"], []], *columns).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("count")
    )
    # Bits of the grouping id: level 4, service 2, message 1; a set bit is a column left out.
    kind = (
        F.when(F.col("gid") == 3, "level")
        .when(F.col("gid") == 5, "service")
        .when(F.col("gid") == 6, "message")
        .otherwise("total")
    )
    return counted.select(kind.alias("kind"), F.coalesce(*columns).alias("key"), "count")


def summarize(logs: DataFrame, query: str = "", tr: TimeRange | None = None) -> DataFrame:
    """One row: count, level and service histograms, the five top messages and a sentence.

    Only the top messages leave their task; the histograms of levels and services are part of the
    sentence and so as long as there are distinct levels and services.
    """
    counts = histograms(logs, query, tr)
    is_message = F.col("kind") == "message"
    # Everything that is not a message ranks alike, so only messages are cut to the best five.
    ranked = counts.withColumn(
        "rank",
        F.row_number().over(
            W.partitionBy("kind", F.when(~is_message, F.col("key"))).orderBy(F.col("count").desc(), "key")
        ),
    ).where(F.col("rank") <= TOP_MESSAGES)

    def listed(kind):
        item = F.struct(F.col("key"), F.col("count"))
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, item)))

    top = F.sort_array(
        F.collect_list(F.when(is_message, F.struct(F.col("rank"), F.col("key"), F.col("count"))))
    )
    folded = ranked.agg(
        F.max(F.when(F.col("kind") == "total", F.col("count"))).alias("count"),
        listed("level").alias("levels"),
        listed("service").alias("services"),
        top.alias("top"),
    )

    def spelled(name):
        return F.array_join(
            F.transform(name, lambda e: F.concat(e["key"], F.lit(": "), e["count"].cast("string"))), ", "
        )

    found = F.coalesce(F.col("count"), F.lit(0))
    first = F.try_element_at("top", F.lit(1))
    # The parts of the sentence.
    sentence = F.concat(
        F.lit("Analyzed "), found.cast("string"), F.lit(" log entries. Levels — "), spelled("levels"),
        F.lit(". Services — "), spelled("services"), F.lit(". Top message: '"), first["key"],
        F.lit("' ("), first["count"].cast("string"), F.lit(" occurrences)."),
    )
    return folded.select(
        found.alias("count"),
        F.map_from_entries("levels").alias("levels"),
        F.map_from_entries("services").alias("services"),
        F.transform("top", lambda m: m["key"]).alias("top_messages"),
        F.when(found > 0, sentence).otherwise(F.lit(NOTHING_FOUND)).alias("summary"),
    )
