"""Correlation by trace and by closeness in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timeexpr import TimeRange, micros, parse_window
from ..functions.timestamps import epoch_cell, iso_text
from ..schema import is_alarm
from ..sources.catalog import choose_sources
from .predicates import filter_logs, in_time_range
from .reuse import never_null, whole_rows

# Cells per block: a window over one block sees at most this many rows.
CELLS_PER_BLOCK = 65_536

# `group_id` of the trace group; time groups are numbered from 1.
TRACE_GROUP = 0

GROUP_COLUMNS = ("group_id", "correlation_type", "correlation_key", "score", "start_ts", "end_ts", "entries")


def group_score(alarms: Column, entries: Column) -> Column:
    """Share of ERROR, WARN and WARNING entries plus 0.1, at most 1, two decimals."""
    return F.round(F.least(alarms / entries + F.lit(0.1), F.lit(1.0)), 2)


def correlate_trace(
    logs: DataFrame, trace_id: str, sources=None, tr: TimeRange | None = None
) -> DataFrame:
    """All entries of one trace over the chosen sources, in time order."""
    found = choose_sources(filter_logs(logs, trace_id=trace_id, tr=tr), sources)
    return found.orderBy(F.col("ts").asc_nulls_last(), "source", "seq")


def trace_groups(logs: DataFrame, sources=None, tr: TimeRange | None = None) -> DataFrame:
    """Every trace at once: entries, span of time, sources and services touched.

    The sets are of distinct names, combined inside every task; two distinct counts would expand every row instead.
    Entries without a trace are left out first, else they would form one giant group.
    """
    traced = choose_sources(in_time_range(logs, tr), sources).where(F.col("trace_id").isNotNull())
    return traced.groupBy("trace_id").agg(
        F.count("*").alias("entries"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.size(F.collect_set("source")).cast("bigint").alias("sources"),
        F.size(F.collect_set("service")).cast("bigint").alias("services"),
    )


def _near_entries(logs: DataFrame, service: str | None, tr: TimeRange | None) -> DataFrame:
    return filter_logs(logs, service=service, tr=tr).where(F.col("ts").isNotNull())


def cells_of(near: DataFrame, cell: Column, *keys: str) -> DataFrame:
    """Entries folded into cells of time (by key): first and last time, entries and alarms. Cells can be folded again."""
    return near.groupBy(never_null(cell, 0).alias("cell"), *keys).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("entries"),
        F.count_if(is_alarm()).alias("alarms"),
    )


def fold_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Several rows of a cell (and key) as one."""
    return cells.groupBy(never_null(F.col("cell"), 0).alias("cell"), *keys).agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("entries").alias("entries"),
        F.sum("alarms").alias("alarms"),
    )


def _chained_cells(near: DataFrame, gap: int, cell: Column) -> DataFrame:
    return chained(cells_of(near, cell), gap)


def chained(cells: DataFrame, gap: int) -> DataFrame:
    """Occupied cells with the number of the chain they belong to.

    A cell is as wide as the gap, so entries of one cell always chain and only cell borders can
    break. Breaks are numbered inside blocks of cells, and the blocks, one row each, are totalled
    to continue the numbers; no window sees the entries themselves.
    """
    cells = whole_rows(cells)
    block = never_null(F.call_function("div", F.col("cell"), F.lit(CELLS_PER_BLOCK)), 0)
    inside = W.partitionBy("block").orderBy("cell")
    apart = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(inside)) > gap
    cells = (
        cells.withColumn("block", block)
        .withColumn("breaks", F.coalesce(apart, F.lit(False)).cast("bigint"))
        .withColumn("breaks_so_far", F.sum("breaks").over(inside))
    )
    blocks = cells.groupBy("block").agg(
        F.min("first_ts").alias("block_first"),
        F.max("last_ts").alias("block_last"),
        F.sum("breaks").alias("block_breaks"),
    )
    # One row per block: span / (gap * CELLS_PER_BLOCK) rows.
    along = W.orderBy("block")
    previous = F.lag("block_last").over(along)
    opens = previous.isNull() | (F.unix_micros("block_first") - F.unix_micros(previous) > gap)
    blocks = blocks.withColumn("opens", opens.cast("bigint")).select(
        "block",
        (F.sum(F.col("opens") + F.col("block_breaks")).over(along) - F.col("block_breaks")).alias("base"),
    )
    return cells.join(blocks, "block").select(
        "cell",
        (F.col("base") + F.col("breaks_so_far")).alias("group_id"),
        "first_ts",
        "last_ts",
        "entries",
        "alarms",
    )


def groups_of(cells: DataFrame) -> DataFrame:
    groups = cells.groupBy("group_id").agg(
        F.min("first_ts").alias("start_ts"),
        F.max("last_ts").alias("end_ts"),
        F.sum("entries").alias("entries"),
        F.sum("alarms").alias("alarms"),
    )
    key = F.concat(iso_text(F.col("start_ts")), F.lit(" to "), iso_text(F.col("end_ts")))
    return groups.select(
        "group_id",
        F.lit("timestamp_proximity").alias("correlation_type"),
        key.alias("correlation_key"),
        group_score(F.col("alarms"), F.col("entries")).alias("score"),
        "start_ts",
        "end_ts",
        "entries",
    )


def correlate_time(
    logs: DataFrame, window: str = "5m", service: str | None = None, tr: TimeRange | None = None
) -> DataFrame:
    """Chains of entries whose gap to the previous entry is at most the window, one row each.

    `group_id` numbers the chains by time. Entries without a time are left out.
    """
    gap = parse_window(window)
    near = _near_entries(logs, service, tr)
    cells = _chained_cells(near, micros(gap), epoch_cell(F.col("ts"), gap))
    return groups_of(cells)


def correlated_entries(
    logs: DataFrame, window: str = "5m", service: str | None = None, tr: TimeRange | None = None
) -> DataFrame:
    """The entries of `correlate_time` with their `group_id`.

    Joined by cell, so the small side is one row per occupied cell. Its measured size decides
    whether it is broadcast; otherwise the sort-merge join splits a hot cell.
    """
    gap = parse_window(window)
    cell = epoch_cell(F.col("ts"), gap)
    near = _near_entries(logs, service, tr)
    cells = _chained_cells(near, micros(gap), cell).select("cell", "group_id")
    return near.withColumn("cell", cell).join(cells, "cell").drop("cell")


def correlate(
    logs: DataFrame,
    sources=None,
    trace_id: str | None = None,
    service: str | None = None,
    window: str = "5m",
    tr: TimeRange | None = None,
) -> DataFrame:
    """Trace group if a trace is given, time groups if a service is given or no trace is.

    `group_id` names the groups in `correlate_entries`. Highest score first; on ties the trace group, then the earlier group.
    """
    chosen = choose_sources(logs, sources)
    parts = []
    if trace_id:
        traced = filter_logs(chosen, trace_id=trace_id, tr=tr)
        group = traced.agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("entries")
        ).where(F.col("entries") > 0)
        parts.append(
            group.select(
                F.lit(TRACE_GROUP).cast("bigint").alias("group_id"),
                F.lit("trace_id").alias("correlation_type"),
                F.lit(trace_id).alias("correlation_key"),
                F.lit(1.0).alias("score"),
                "start_ts",
                "end_ts",
                "entries",
            )
        )
    if service or not trace_id:
        parts.append(correlate_time(chosen, window, service, tr).select(*GROUP_COLUMNS))
    groups = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    trace_last = F.col("correlation_type") == "timestamp_proximity"
    return groups.orderBy(F.col("score").desc(), trace_last, "start_ts")


def correlate_entries(
    logs: DataFrame,
    sources=None,
    trace_id: str | None = None,
    service: str | None = None,
    window: str = "5m",
    tr: TimeRange | None = None,
    group_id: int | None = None,
) -> DataFrame:
    """The entries of the groups of `correlate` with their `group_id`, or those of one group.

    An entry of the trace may be in a time group as well and then has a row for each.
    """
    chosen = choose_sources(logs, sources)
    parts = []
    if trace_id and group_id in (None, TRACE_GROUP):
        traced = filter_logs(chosen, trace_id=trace_id, tr=tr)
        parts.append(traced.withColumn("group_id", F.lit(TRACE_GROUP).cast("bigint")))
    if (service or not trace_id) and group_id != TRACE_GROUP:
        parts.append(correlated_entries(chosen, window, service, tr))
    nothing = chosen.where(F.lit(False)).withColumn("group_id", F.lit(TRACE_GROUP).cast("bigint"))
    entries = reduce(DataFrame.unionByName, parts or [nothing])
    return entries if group_id is None else entries.where(F.col("group_id") == group_id)


def correlate_total(
    logs: DataFrame,
    sources=None,
    trace_id: str | None = None,
    service: str | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """Entries looked at: those of the trace plus, if time groups are made, all in the range."""
    seen = choose_sources(in_time_range(logs, tr), sources)
    found = F.lit(0)
    if trace_id:
        found = found + F.count_if(F.col("trace_id") == trace_id)
    if service or not trace_id:
        found = found + F.count("*")
    return seen.agg(found.alias("total_entries"))
