"""Row filters."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeexpr import TimeRange, UTC

# Keys under which a raw JSON line names its trace.
TRACE_PROBES = ("traceId", "trace_id")


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def in_time_range(logs: DataFrame, tr: TimeRange | None) -> DataFrame:
    """Entries inside the range, both ends inclusive, and entries without a readable time.

    A `dt` column, as the log table has, is bounded too, so that whole days are skipped. Days are UTC in any session.
    """
    if tr is None or (tr.start is None and tr.end is None):
        return logs
    ts = F.col("ts")
    kept = logs.where(ts.isNull() | tr.holds(ts))
    if "dt" in logs.columns:
        day = F.col("dt")
        bounds = []
        if tr.start is not None:
            bounds.append(day >= F.lit(tr.start.astimezone(UTC).date()))
        if tr.end is not None:
            bounds.append(day <= F.lit(tr.end.astimezone(UTC).date()))
        kept = kept.where(day.isNull() | _all(bounds))
    return kept


def search(logs: DataFrame, query: str, tr: TimeRange | None = None) -> DataFrame:
    """Case-insensitive substring of message, service, host or a string field, or the level itself.

    The empty query keeps every row.
    """
    logs = in_time_range(logs, tr)
    if not query:
        return logs
    lowered = query.lower()
    return logs.where(F.col("search_text").contains(lowered) | (F.lower("level") == lowered))


def same_text(column: Column, value) -> Column:
    """Equality with the text of `value`; booleans in any letter case."""
    text = str(value)
    if text.lower() in ("true", "false"):
        return F.lower(column) == text.lower()
    return column == text


def filter_logs(
    logs: DataFrame,
    level: str | None = None,
    service: str | None = None,
    host: str | None = None,
    trace_id: str | None = None,
    custom_fields: dict | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """All given conditions: level in any letter case, the rest exact; unset ones do not filter."""
    parts = []
    if level:
        parts.append(F.upper("level") == level.upper())
    for name, value in (("service", service), ("host", host), ("trace_id", trace_id)):
        if value:
            parts.append(F.col(name) == value)
    for key, value in (custom_fields or {}).items():
        parts.append(same_text(F.col("fields")[key], value))
    return in_time_range(logs, tr).where(_all(parts))


def line_contains(logs: DataFrame, text: str) -> DataFrame:
    """Case-sensitive substring of the line as it was read, or of the message if there is none."""
    text = text.strip()
    return logs.where(F.coalesce("raw", "message").contains(text)) if text else logs


def label(name: str) -> Column:
    """A stream label: the key in `fields`, else the envelope column of that name."""
    inside = F.col("fields")[name]
    return F.coalesce(inside, F.col(name)) if name in ("level", "service", "host", "source") else inside


def match_labels(
    logs: DataFrame,
    labels: dict | None = None,
    defaults: dict | None = None,
    custom_fields: dict | None = None,
    trace_id: str | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """Label equality, level in any letter case. Given labels replace the defaults.

    Field and trace conditions are added to either.
    """
    parts = []
    for name, value in (labels or defaults or {}).items():
        found = label(name)
        if name == "level":
            parts.append(F.lower(found) == value.lower())
        else:
            parts.append(found == value)
    for key, value in (custom_fields or {}).items():
        parts.append(same_text(F.col("fields")[key], value))
    if trace_id:
        parts.append(F.col("trace_id") == trace_id)
    return in_time_range(logs, tr).where(_all(parts))


def line_matches(logs: DataFrame, regex: str) -> DataFrame:
    """Regex found anywhere in the message."""
    return logs.where(F.col("message").rlike(regex)) if regex else logs


def filter_stream(
    logs: DataFrame,
    level: str | None = None,
    service: str | None = None,
    host: str | None = None,
    trace_id: str | None = None,
    custom_fields: dict | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """Probes of lines that were not parsed; `host` is the log stream.

    Alternatives of one condition are joined by OR, conditions by AND. Level, service and host
    are regexes, trace and custom fields are JSON text in the line.
    """
    line, stream = F.col("message"), F.col("host")

    def pair(key, value, gaps=("", " ")):
        return reduce(or_, [line.contains(f'"{key}":{gap}"{value}"') for gap in gaps])

    parts = []
    if level:
        parts.append(line.rlike(level))
    for value in (service, host):
        if value:
            parts.append(stream.rlike(value))
    if trace_id:
        parts.append(reduce(or_, [pair(key, trace_id, ("",)) for key in TRACE_PROBES]))
    for key, value in (custom_fields or {}).items():
        parts.append(pair(key, value))
    return in_time_range(logs, tr).where(_all(parts))


def filter_attributes(
    logs: DataFrame,
    status: str | None = None,
    service: str | None = None,
    host: str | None = None,
    trace_id: str | None = None,
    attributes: dict | None = None,
    tr: TimeRange | None = None,
) -> DataFrame:
    """Attribute equality, all conditions together; the status in any letter case."""
    return filter_logs(logs, status, service, host, trace_id, attributes, tr)
