"""Log analytics as plain DataFrame functions on Spark."""

from .functions.timeexpr import TimeRange
from .logbook import LogBook
from .schema import LOG_SCHEMA
from .session import configure, shared_dir

__all__ = ["LOG_SCHEMA", "LogBook", "TimeRange", "configure", "shared_dir"]
