"""Counting and numeric aggregation by key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeexpr import TimeRange, parse_width
from ..functions.timestamps import epoch_bucket, time_bucket
from ..functions.values import number
from ..schema import COLUMNS, UNKNOWN
from .ordering import top_n
from .predicates import in_time_range, label
from .reuse import never_null, whole_rows

BUCKET = "timestamp_bucket"
DEFAULT_WIDTH = "5m"

# Stands for a facet that an entry lacks; such entries belong to no facet value.
NO_FACET = "\u0000"


# Columns that are not key material even though the log table has them.
_NOT_KEYS = ("fields", "search_text")


def group_key(name: str) -> Column:
    """Key value of an entry: the level as it is, everything else `unknown` when missing."""
    if name == "level":
        return F.col("level")
    if name in COLUMNS and name not in _NOT_KEYS:
        return F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))
    return F.coalesce(F.col("fields")[name], F.lit(UNKNOWN))


def numeric_field(name: str) -> Column:
    """Number in a field; `level` never is one."""
    return F.lit(None).cast("double") if name == "level" else number(F.col("fields")[name])


def metric_name(metric: str) -> str:
    """Known metric, `average` reads as avg and anything else as count."""
    lowered = metric.lower()
    if lowered in ("avg", "average"):
        return "avg"
    return lowered if lowered in ("sum", "min", "max") else "count"


def metric_value(metric: str, numeric: Column | None) -> Column:
    """Aggregate of `numeric`; 0.0 when no value is numeric, the row count for `count`."""
    name = metric_name(metric)
    if name == "count":
        return F.count("*").cast("double")
    if numeric is None:
        return F.lit(0.0)
    fold = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[name]
    return F.coalesce(fold(numeric), F.lit(0.0))


def aggregate(
    logs: DataFrame,
    group_by=(),
    metric: str = "count",
    field: str | None = None,
    bucket: str | None = None,
    limit: int | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """One row per key: the keys, `value` DOUBLE and `count` BIGINT.

    A bucket is a key even if it is not listed. With `limit` the highest counts come first.
    """
    names = [n for n in dict.fromkeys(group_by) if n != BUCKET]
    keys = [group_key(n).alias(n) for n in names]
    if bucket:
        keys.append(time_bucket(F.col("ts"), bucket).alias(BUCKET))
    value = metric_value(metric, numeric_field(field) if field else None)
    buckets = in_time_range(logs, tr).groupBy(*keys).agg(
        value.alias("value"), F.count("*").alias("count")
    )
    if not keys:
        buckets = buckets.where(F.col("count") > 0)
    return buckets if limit is None else top_n(buckets, limit)


def count_by_epoch(logs: DataFrame, width: str, group_by=()) -> DataFrame:
    """Rows per fixed-width bin counted from the epoch, and per key."""
    keys = [group_key(n).alias(n) for n in group_by]
    start = epoch_bucket(F.col("ts"), parse_width(width)).alias(BUCKET)
    return logs.where(F.col("ts").isNotNull()).groupBy(start, *keys).agg(F.count("*").alias("count"))


def over_time(
    logs: DataFrame,
    func: str,
    width: str | None = None,
    by=(),
    field: str | None = None,
    series=("source", "level", "service", "host"),
) -> DataFrame:
    """Function per series and bin, then the sum over the series that share the labels `by`.

    `series` names the labels that make a series; without `by` each series is kept. Functions
    other than count need a numeric field, and bins without a number give no row.
    """
    name = metric_name(func)
    if name != "count" and not field:
        raise ValueError(f"{func} over time needs a numeric field")
    labels = [n for n in by if n != BUCKET]
    start = epoch_bucket(F.col("ts"), parse_width(width or DEFAULT_WIDTH)).alias(BUCKET)
    timed = logs.where(F.col("ts").isNotNull())
    if name == "count":
        value = F.count("*").cast("double")
    else:
        numeric = numeric_field(field)
        timed = timed.where(numeric.isNotNull())
        value = metric_value(name, numeric)
    parts = list(dict.fromkeys([*series, *labels]))
    each = timed.groupBy(start, *[label(n).alias(n) for n in parts]).agg(value.alias("value"))
    if not labels:
        return each
    return each.groupBy(BUCKET, *labels).agg(F.sum("value").alias("value"))


def stats_by(
    logs: DataFrame,
    func: str = "count",
    keys=(),
    field: str | None = None,
    width: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Metric by keys, highest first. `service` and `host` both mean the log stream.

    Without keys the rows fall into bins (5 minutes unless given). A metric without a field counts.
    """
    columns = {}
    for key in keys:
        if key == BUCKET:
            columns[BUCKET] = epoch_bucket(F.col("ts"), parse_width(width or DEFAULT_WIDTH))
        elif key in ("service", "host"):
            columns["log_stream"] = F.col("host")
        else:
            columns[key] = F.col(key) if key in COLUMNS else F.col("fields")[key]
    if not columns:
        columns[BUCKET] = epoch_bucket(F.col("ts"), parse_width(width or DEFAULT_WIDTH))
    value = metric_value(func if field else "count", numeric_field(field) if field else None)
    found = logs.groupBy(*[c.alias(n) for n, c in columns.items()]).agg(value.alias("value"))
    ranked = found.orderBy(F.col("value").desc(), *columns)
    return ranked if limit is None else ranked.limit(limit)


def _facet(name: str) -> tuple[str, Column]:
    if name in (BUCKET, "timestamp"):
        return "timestamp", F.col("ts").cast("string")
    if name in ("level", "status"):
        return "status", F.lower("level")
    return name, F.col(name) if name in COLUMNS else F.col("fields")[name]


def facet_counts(
    logs: DataFrame,
    facets=(),
    func: str = "count",
    field: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Metric by facets, over the `limit` most frequent values of each facet.

    Without facets the facet is the timestamp. Rows are folded to one per facet combination first;
    the value totals and the semi-joins work on those. Their sides are
    broadcast only where their measured size allows it.
    """
    chosen = dict(_facet(n) for n in (facets or [BUCKET]))
    value = metric_value(func if field else "count", numeric_field(field) if field else None)
    keys = [never_null(c, NO_FACET).alias(n) for n, c in chosen.items()]
    cells = logs.groupBy(*keys).agg(
        value.alias("value"), F.count("*").alias("count")
    )
    cells = kept = whole_rows(cells)
    for name in chosen:
        totals = cells.groupBy(name).agg(F.sum("count").alias("n"))
        # Mentions the total so that it is not pushed below it.
        totals = totals.where(F.when(F.col("n") > 0, F.col(name) != NO_FACET))
        best = totals.orderBy(F.col("n").desc(), name).limit(limit).select(name)
        kept = kept.join(best, name, "left_semi")
    return kept


def total(logs: DataFrame, tr: TimeRange | None = None) -> DataFrame:
    """Number of rows in the range, before any bucket limit."""
    return in_time_range(logs, tr).agg(F.count("*").alias("total"))
