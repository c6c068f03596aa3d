"""Comparison of two periods of the same logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timeexpr import TimeRange
from ..functions.values import percent_change, two_decimals
from ..schema import UNKNOWN, is_alarm
from .predicates import in_time_range, search
from .reuse import whole_rows

TOP = 5
NAMED_IN_SUMMARY = 3
NOTABLE_PERCENT = 50

# Kinds of rows in the counts.
TOTAL, ERRORS, SERVICE, MESSAGE = "total", "errors", "service", "message"


def hull(a: TimeRange, b: TimeRange) -> TimeRange:
    """The range from the earlier start to the later end; an end that is open in either is open."""
    start = min(a.start, b.start) if a.start and b.start else None
    return TimeRange(start, max(a.end, b.end) if a.end and b.end else None)


def period_counts(
    logs: DataFrame, baseline: TimeRange, comparison: TimeRange, query: str = ""
) -> DataFrame:
    """Rows in each period per message, per service and in total: kind, key, baseline, comparison.

    One scan: a row stands once for its message, once for its service and once for the total, and
    every task combines its counts before the shuffle. A row may count in both periods when they
    overlap. Entries without a time belong to both, as they pass every time filter.
    """
    ts = F.col("ts")

    def stands_for(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    marks = F.array(
        stands_for(MESSAGE, F.col("message")),
        stands_for(SERVICE, F.coalesce("service", F.lit(UNKNOWN))),
        stands_for(TOTAL, F.lit(None).cast("string")),
    )
    tagged = in_time_range(search(logs, query), hull(baseline, comparison)).select(
        is_alarm().alias("alarm"),
        (ts.isNull() | baseline.holds(ts)).alias("in_baseline"),
        (ts.isNull() | comparison.holds(ts)).alias("in_comparison"),
        marks.alias("marks"),
    )
    tagged = tagged.where(F.col("in_baseline") | F.col("in_comparison"))
    counted = (
        tagged.select("alarm", "in_baseline", "in_comparison", F.explode("marks").alias("mark"))
        .groupBy(F.col("mark.kind").alias("kind"), F.col("mark.key").alias("key"))
        .agg(
            F.count_if("in_baseline").alias("baseline"),
            F.count_if("in_comparison").alias("comparison"),
            F.count_if(F.col("in_baseline") & F.col("alarm")).alias("baseline_errors"),
            F.count_if(F.col("in_comparison") & F.col("alarm")).alias("comparison_errors"),
        )
    )
    return whole_rows(counted)


def error_rate(errors: Column, total: Column) -> Column:
    return errors / F.greatest(total, F.lit(1))


def period_stats(logs: DataFrame, tr: TimeRange, query: str = "") -> DataFrame:
    """Total, errors and error rate of one period."""
    return (
        in_time_range(search(logs, query), tr)
        .agg(F.count("*").alias("total"), F.count_if(is_alarm()).alias("errors"))
        .withColumn("error_rate", F.round(error_rate(F.col("errors"), F.col("total")), 4))
    )


def top_keys(counts: DataFrame, kind: str, period: str) -> DataFrame:
    """The five most frequent messages or services of one period."""
    found = counts.where((F.col("kind") == kind) & (F.col(period) > 0))
    return found.orderBy(F.col(period).desc(), "key").limit(TOP).select("key", F.col(period).alias("count"))


def new_messages(counts: DataFrame) -> DataFrame:
    """Messages of the comparison period that the baseline does not have.

    Read off the counts: both periods of a message are on one row, so no join is needed.
    """
    found = counts.where((F.col("kind") == MESSAGE) & (F.col("baseline") == 0))
    return found.select(F.col("key").alias("message"))


def disappeared_messages(counts: DataFrame) -> DataFrame:
    """Messages of the baseline that the comparison period does not have."""
    found = counts.where((F.col("kind") == MESSAGE) & (F.col("comparison") == 0))
    return found.select(F.col("key").alias("message"))


class MessageChanges(NamedTuple):
    new: DataFrame
    disappeared: DataFrame


def message_changes(
    logs: DataFrame, baseline: TimeRange, comparison: TimeRange, query: str = ""
) -> MessageChanges:
    """Both lists of messages that only one of the periods has, from the same counts."""
    counts = period_counts(logs, baseline, comparison, query)
    return MessageChanges(new_messages(counts), disappeared_messages(counts))


def _volume_text(change: Column, appeared: str, grew: str, shrank: str, stable: str) -> Column:
    size = two_decimals(F.abs(change))
    return (
        F.when(change == F.lit(float("inf")), F.lit(appeared))
        .when(change > NOTABLE_PERCENT, F.concat(F.lit(grew), size, F.lit("%.")))
        .when(change < -NOTABLE_PERCENT, F.concat(F.lit(shrank), size, F.lit("%.")))
        .otherwise(F.lit(stable))
    )


def compare_periods(
    logs: DataFrame, baseline: TimeRange, comparison: TimeRange, query: str = ""
) -> DataFrame:
    """One row: counts, rates, changes, the top messages and services of each period, a sentence.

    The full lists of new and disappeared messages are `new_messages` and `disappeared_messages`;
    here their numbers and, in the sentence, the first three new ones.
    """
    counts = period_counts(logs, baseline, comparison, query)
    kind, key = F.col("kind"), F.col("key")
    is_new = (kind == MESSAGE) & (F.col("baseline") == 0)
    is_gone = (kind == MESSAGE) & (F.col("comparison") == 0)

    # Per kind only the first rows of three orders are needed; each order is cut inside every task
    # before the shuffle. All branches read all counts and none filters below them, so that they
    # share the one aggregated exchange.
    def first(part, n, *order):
        place = F.row_number().over(W.partitionBy("kind").orderBy(*order))
        ranked = counts.withColumn("place", place).where(F.col("place") <= n)
        return ranked.withColumn("part", F.lit(part))

    rows = (
        first("b", TOP, F.col("baseline").desc(), key)
        .unionByName(first("c", TOP, F.col("comparison").desc(), key))
        .unionByName(first("n", NAMED_IN_SUMMARY, is_new.desc(), key))
    )
    numbers = ("baseline", "comparison", "baseline_errors", "comparison_errors")
    total_of = [F.max(F.when(kind == TOTAL, F.col(c))).alias(c) for c in numbers]
    totals = counts.agg(
        F.struct(*total_of, F.count_if(is_new).alias("new"), F.count_if(is_gone).alias("gone")).alias("t")
    )

    def listed(part, wanted, column):
        item = F.when(
            (F.col("part") == part) & (F.col("kind") == wanted), F.struct("place", "key", *numbers)
        )
        found = F.filter(F.sort_array(F.collect_list(item)), lambda e: e[column] > 0)
        return F.transform(found, lambda e: F.struct(e["key"].alias("key"), e[column].alias("count")))

    new_item = F.when((F.col("part") == "n") & is_new, F.struct("place", "key", *numbers))
    folded = rows.agg(
        listed("b", MESSAGE, "baseline").alias("top_messages_baseline"),
        listed("c", MESSAGE, "comparison").alias("top_messages_comparison"),
        listed("b", SERVICE, "baseline").alias("services_baseline"),
        listed("c", SERVICE, "comparison").alias("services_comparison"),
        F.sort_array(F.collect_list(new_item)).alias("first_new"),
    ).select("*", totals.scalar().alias("t"))
    folded = folded.select(
        F.coalesce("t.baseline", F.lit(0)).alias("baseline_total"),
        F.coalesce("t.comparison", F.lit(0)).alias("comparison_total"),
        F.coalesce("t.baseline_errors", F.lit(0)).alias("baseline_errors"),
        F.coalesce("t.comparison_errors", F.lit(0)).alias("comparison_errors"),
        F.col("t.new").alias("new_messages"),
        F.col("t.gone").alias("disappeared_messages"),
        *[c for c in folded.columns if c != "t"],
    )
    rate_b = error_rate(F.col("baseline_errors"), F.col("baseline_total"))
    rate_c = error_rate(F.col("comparison_errors"), F.col("comparison_total"))
    measured = folded.select(
        "*",
        percent_change(F.col("baseline_total"), F.col("comparison_total")).alias("total_change"),
        percent_change(F.col("baseline_errors"), F.col("comparison_errors")).alias("error_change"),
        F.round(rate_b, 4).alias("baseline_rate"),
        F.round(rate_c, 4).alias("comparison_rate"),
        F.round(rate_c - rate_b, 4).alias("rate_change"),
    )
    # The sentences of the summary.
    volume = _volume_text(
        F.col("total_change"),
        "Log volume went from zero to present.",
        "Log volume increased by ",
        "Log volume decreased by ",
        "Log volume is relatively stable.",
    )
    errors = _volume_text(
        F.col("error_change"),
        "Errors went from zero to present.",
        "Errors increased by ",
        "Errors decreased by ",
        "Error rate is relatively stable.",
    )
    named = F.array_join(F.transform("first_new", lambda e: e["key"]), ", ")
    appeared = F.when(
        F.size("first_new") > 0, F.concat(F.lit("New messages appeared: "), named, F.lit("."))
    )
    return measured.withColumn("summary", F.concat_ws(" ", volume, errors, appeared)).drop("first_new")
