"""Range and window texts. They are resolved once on the driver and enter plans as literals."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

UTC = timezone.utc

# Unit letters and their seconds.
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}

_DELTA = re.compile(r"(?:[0-9.]+[dhms])*")
_NUMBER = re.compile(r"[0-9]+")
_DELTA_PART = re.compile(r"([0-9.]+)([dhms])")


def parse_delta(text: str) -> timedelta:
    """`1d2h30m5s`, decimals allowed; the empty text is zero."""
    text = text.strip()
    if not _DELTA.fullmatch(text):
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sum(float(n) * UNIT_SECONDS[u] for n, u in _DELTA_PART.findall(text)))


def resolve_time(text: str | datetime, reference: datetime | None = None) -> datetime:
    """ISO text in any letter case, `now`, `now-1h`, `now+30m`. A missing zone means UTC."""
    if isinstance(text, datetime):
        moment = text
    else:
        word = text.strip().lower()
        if word.startswith("now"):
            base = reference or datetime.now(UTC)
            rest = word[3:]
            if rest and rest[0] not in "+-":
                raise ValueError(f"not a time: {text!r}")
            shift = parse_delta(rest[1:])
            moment = base - shift if rest[:1] == "-" else base + shift
        else:
            try:
                moment = datetime.fromisoformat(word.upper())
            except ValueError:
                raise ValueError(f"not a time: {text!r}") from None
    return moment if moment.tzinfo else moment.replace(tzinfo=UTC)


def parse_window(text: str) -> timedelta:
    """Correlation window: a number (5 if there is none) and its unit, which is minutes unless it is `h` or `s`."""
    number, unit = _NUMBER.search(text), _NUMBER.sub("", text)
    return parse_delta(f"{number[0] if number else 5}{unit if unit in ('h', 's') else 'm'}")


def parse_width(text: str) -> timedelta:
    """A bucket width that must be longer than zero."""
    width = parse_delta(text)
    if width <= timedelta():
        raise ValueError(f"width must be positive: {text!r}")
    return width


def micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)


@dataclass(frozen=True)
class TimeRange:
    """Both ends inclusive, either end open."""

    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def of(cls, start=None, end=None, reference: datetime | None = None) -> "TimeRange":
        return cls(
            resolve_time(start, reference) if start is not None else None,
            resolve_time(end, reference) if end is not None else None,
        )

    def holds(self, ts: Column) -> Column:
        """True for a time inside the range; a null time is not inside."""
        found = F.lit(True)
        if self.start is not None:
            found = found & (ts >= F.lit(self.start))
        if self.end is not None:
            found = found & (ts <= F.lit(self.end))
        return found & ts.isNotNull()


def default_range(store: str, operation: str, reference: datetime | None = None) -> TimeRange:
    """The range a store applies when the caller gives none; local files are unbounded."""
    now = reference or datetime.now(UTC)
    if store == "local":
        return TimeRange()
    if operation != "tail":
        return TimeRange(now - timedelta(hours=1), now)
    if store == "cloudwatch":
        hour = now.replace(minute=0, second=0, microsecond=0)
        return TimeRange(hour - timedelta(hours=1), None)
    return TimeRange(now - timedelta(minutes=5), now)
