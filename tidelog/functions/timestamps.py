"""Timestamp parsing, formatting and bucketing as column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, functions as F

from .timeexpr import micros

# The accepted layouts. A zone is only read after the `T` forms.
_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?"
_ZONED = rf"^{_DATE}T{_CLOCK}(Z|[+-]\d{{2}}:?\d{{2}}(:?\d{{2}})?)$"
_BARE = rf"^{_DATE}[T ]{_CLOCK}$"

_BUCKET = re.compile(r"(\d+)([mhd])")


def parse_ts(text: Column) -> Column:
    """Time of a log line, null unless the whole text has an accepted layout.

    The layout is checked first since a bare cast would also take `2026` or `2026-05-24`. Text
    without a zone is UTC whatever the session's zone is.
    """
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return (
        F.when(text.rlike(_ZONED), zoned.try_cast("timestamp"))
        .when(text.rlike(_BARE), F.concat(text, F.lit("Z")).try_cast("timestamp"))
    )


def iso_text(ts: Column) -> Column:
    """ISO 8601 UTC text, with six fraction digits only when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(exact)


def time_bucket(ts: Column, spec: str) -> Column:
    """Start of the bucket: minutes count from the hour, hours from the day, `Nd` is the day.

    Any other spec leaves the time as it is.
    """
    found = _BUCKET.fullmatch(spec)
    if not found:
        return ts
    size, unit = int(found.group(1)), found.group(2)
    if unit == "d":
        return F.date_trunc("DAY", ts)
    if size == 0:
        raise ValueError(f"bucket size must be positive: {spec!r}")
    if unit == "m":
        minutes = F.minute(ts) - F.minute(ts) % size
        return F.date_trunc("HOUR", ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    hours = F.hour(ts) - F.hour(ts) % size
    return F.date_trunc("DAY", ts) + F.make_dt_interval(F.lit(0), hours)


def epoch_cell(ts: Column, width: timedelta) -> Column:
    """Number of the fixed-width cell, counted from the epoch."""
    size = micros(width)
    stamp = F.unix_micros(ts)
    if size <= 1:
        return stamp
    return F.call_function("div", stamp - F.pmod(stamp, F.lit(size)), F.lit(size))


def epoch_bucket(ts: Column, width: timedelta) -> Column:
    """Start of the fixed-width bin, counted from the epoch."""
    stamp = F.unix_micros(ts)
    return F.timestamp_micros(stamp - F.pmod(stamp, F.lit(micros(width))))
