"""All questions about one log table in one place, asked per source.

`LogBook` adds the choice of source and the time range to the operators; every method returns a
DataFrame and none has a row limit unless one is given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from . import sources as src
from .functions.timeexpr import TimeRange, default_range
from .operators import aggregate, compare, correlate, detect, ordering, predicates, root_cause, summary


class LogBook:
    """Logs of the configured sources.

    `sources` lists the ids that may be asked for; left out, any id may be. Time ranges are given
    as (from, to) texts, either of them None, and are resolved against `reference` or now. `stores` says which
    store a source came from; searches, filters, aggregates and tails without a range then take that store's own.
    """

    def __init__(
        self, logs: DataFrame, sources=None, reference: datetime | None = None, stores: dict | None = None
    ) -> None:
        self.logs = logs
        self.stores = dict(stores or {})
        self.sources = list(sources) if sources is not None else None
        self.reference = reference

    def _range(self, time_range) -> TimeRange | None:
        if time_range is None or isinstance(time_range, TimeRange):
            return time_range
        return TimeRange.of(*time_range, reference=self.reference)

    def _usual(self, source, time_range, operation: str) -> TimeRange | None:
        if time_range is None and source in self.stores:
            return default_range(self.stores[source], operation, self.reference)
        return self._range(time_range)

    def _of(self, source: str | None) -> DataFrame:
        if source is None:
            return self.logs
        if self.sources is not None and source not in self.sources:
            raise KeyError(f"unknown source: {source}")
        return self.logs.where(F.col("source") == source)

    def list_sources(self) -> DataFrame:
        return src.list_sources(self.logs)

    def health(self, *asked: str, files: DataFrame | None = None) -> DataFrame:
        configured = self.sources if self.sources is not None else list(asked)
        return src.source_health(self.logs, configured, list(asked) or None, files)

    def schema(self, source: str, kind: str = "local") -> DataFrame:
        return src.describe_schema(self._of(source), source, kind)

    def known_formats(self, source: str, kind: str = "local") -> DataFrame:
        return src.known_formats(self._of(source), None, kind)

    def latest(self, source, limit=100) -> DataFrame:
        """Newest first; in a log table only the newest days are read."""
        logs = self._of(source)
        return ordering.latest(ordering.newest_days(logs, limit) if "dt" in logs.columns else logs, limit)

    def page(self, source, cursor=None, limit=100, time_range=None) -> DataFrame:
        """The page after the token of an entry, newest first; the first page without one."""
        if cursor is None and time_range is None:
            return self.latest(source, limit)
        found = predicates.in_time_range(self._of(source), self._range(time_range))
        return ordering.page_after(found, cursor, limit)

    cursor = staticmethod(ordering.encode_cursor)
    next_offset = staticmethod(ordering.next_offset)

    def search(self, source, query, time_range=None, limit=None, offset=0) -> DataFrame:
        found = predicates.search(self._of(source), query, self._usual(source, time_range, "search"))
        return found if limit is None else ordering.first_matches(found, limit, offset)

    def filter(
        self, source, level=None, service=None, host=None, trace_id=None, custom_fields=None,
        time_range=None, limit=None, offset=0,
    ) -> DataFrame:
        found = predicates.filter_logs(
            self._of(source), level, service, host, trace_id, custom_fields, self._usual(source, time_range, "filter")
        )
        return found if limit is None else ordering.first_matches(found, limit, offset)

    def tail(self, source, lines=50, filter_query=None) -> DataFrame:
        logs = predicates.in_time_range(self._of(source), self._usual(source, None, "tail"))
        return ordering.tail(logs, lines, filter_query)

    def aggregate(
        self, source, group_by=(), metric="count", field=None, time_bucket=None, time_range=None, limit=None
    ) -> DataFrame:
        return aggregate.aggregate(
            self._of(source), group_by, metric, field, time_bucket, limit,
            self._usual(source, time_range, "aggregate"),
        )

    def total(self, source, time_range=None) -> DataFrame:
        return aggregate.total(self._of(source), self._range(time_range))

    def summarize(self, source, query="", time_range=None) -> DataFrame:
        return summary.summarize(self._of(source), query, self._range(time_range))

    def correlate(self, sources=None, time_range=None, trace_id=None, service=None, window="5m") -> DataFrame:
        return correlate.correlate(self.logs, sources, trace_id, service, window, self._range(time_range))

    def correlate_entries(
        self, sources=None, time_range=None, trace_id=None, service=None, window="5m", group_id=None
    ) -> DataFrame:
        """The entries behind `correlate`, of all its groups or of one."""
        tr = self._range(time_range)
        return correlate.correlate_entries(self.logs, sources, trace_id, service, window, tr, group_id)

    def trace_groups(self, sources=None, time_range=None) -> DataFrame:
        return correlate.trace_groups(self.logs, sources, self._range(time_range))

    def root_cause(self, service, time_range=None, symptom="", sources=None) -> root_cause.RootCause:
        return root_cause.root_cause(self.logs, service, self._range(time_range), symptom, sources)

    def compare(self, source, baseline, comparison, query="") -> DataFrame:
        return compare.compare_periods(
            self._of(source), self._range(baseline), self._range(comparison), query
        )

    def compare_messages(self, source, baseline, comparison, query="") -> compare.MessageChanges:
        """All messages that only one of the periods has."""
        return compare.message_changes(
            self._of(source), self._range(baseline), self._range(comparison), query
        )

    def error_patterns(self, source, time_range=None, service=None, min_occurrences=5) -> DataFrame:
        return detect.detect_error_patterns(
            self._of(source), self._range(time_range), service, min_occurrences
        )

    def anomalies(
        self, source, time_range=None, metric="log_volume", sensitivity="medium", bucket="1h", field="latency"
    ) -> DataFrame:
        return detect.find_anomalies(
            self._of(source), self._range(time_range), metric, sensitivity, bucket, (), field
        )
