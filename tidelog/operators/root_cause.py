"""Ranking of likely causes of an incident in one service."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timeexpr import TimeRange
from ..schema import UNKNOWN, WARNING_LEVELS
from ..sources.catalog import choose_sources
from .ordering import timeline
from .predicates import filter_logs, in_time_range

# Words that point at infrastructure.
INFRASTRUCTURE_WORDS = ("timeout", "connection", "database", "db", "refused", "unavailable")

# Confidence of a cause seen n times is min(start + 0.05 n, cap).
STEP = 0.05
UPSTREAM_CONFIDENCE = (0.5, 0.95)
MESSAGE_CONFIDENCE = (0.4, 0.9)
KEYWORD_CONFIDENCE = (0.45, 0.85)
WARNING_CONFIDENCE = 0.6

TOP_MESSAGES = 3
BEST_CAUSES = 5
CAUSE_LENGTH = 80

# Order of the heuristics, which decides between equal confidences.
UPSTREAM, MESSAGE, KEYWORD, WARNINGS, ERRORS = 1, 2, 3, 4, 5


class RootCause(NamedTuple):
    report: DataFrame
    causes: DataFrame
    timeline: DataFrame


def incident_errors(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None
) -> DataFrame:
    """Entries of level ERROR of the affected service."""
    return filter_logs(choose_sources(logs, sources), level="ERROR", service=service, tr=tr)


def incident_context(logs: DataFrame, tr: TimeRange | None = None, sources=None) -> DataFrame:
    """All entries in the window as a timeline."""
    return timeline(choose_sources(logs, sources), tr)


def _confidence(n: Column, start: float, cap: float) -> Column:
    return F.round(F.least(F.lit(start) + n * F.lit(STEP), F.lit(cap)), 4)


def tally(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None, strict: bool = False
) -> DataFrame:
    """All counts the heuristics need, from one scan: heuristic, key, n.

    Each row names what it is evidence for and the names are counted, so tasks combine before the
    shuffle. `strict` looks for other services among the target's own errors only, where an exact
    service filter never finds any; otherwise among all errors of the window.
    """
    window = in_time_range(choose_sources(logs, sources), tr)
    is_error = F.upper("level") == "ERROR"
    # What an error must be to count as the target's, and a warning as context.
    is_warning = F.col("level").isin(*WARNING_LEVELS)
    target = is_error & (F.coalesce("service", F.lit(UNKNOWN)) == service)

    def evidence(heuristic, key):
        return F.struct(F.lit(heuristic).alias("heuristic"), key.alias("key"))

    none = F.lit("")
    message = F.lower("message")
    own = F.concat(
        F.array(evidence(ERRORS, none), evidence(MESSAGE, F.col("message"))),
        F.filter(
            F.array(
                *[
                    F.when(message.contains(word), evidence(KEYWORD, F.lit(word)))
                    for word in INFRASTRUCTURE_WORDS
                ]
            ),
            lambda e: e.isNotNull(),
        ),
    )
    found = F.when(target, own).when(is_warning, F.array(evidence(WARNINGS, none)))
    if not strict:
        other = F.coalesce("service", F.lit(UNKNOWN))
        found = found.when(is_error, F.array(evidence(UPSTREAM, other)))
    return (
        window.where(is_error | is_warning)
        .select(F.explode(found).alias("e"))
        .groupBy("e.heuristic", "e.key")
        .agg(F.count("*").alias("n"))
    )


def _best_evidence(counts: DataFrame) -> DataFrame:
    """The most frequent keys of each heuristic; never more than a handful of rows.

    Also carries the error count, 0 if there is none. Spark cuts each heuristic to its first rows
    inside every task before they meet.
    """
    per = W.partitionBy("heuristic").orderBy(F.col("n").desc(), "key")
    best = counts.withColumn("place", F.row_number().over(per)).where(F.col("place") <= BEST_CAUSES)
    best = best.where((F.col("heuristic") != MESSAGE) | (F.col("place") <= TOP_MESSAGES))
    # At most BEST_CAUSES rows per heuristic here.
    errors = F.max(F.when(F.col("heuristic") == ERRORS, F.col("n"))).over(W.partitionBy(F.lit(1)))
    return best.withColumn("errors", F.coalesce(errors, F.lit(0)))


def _as_causes(best: DataFrame) -> DataFrame:
    kind, key, n = F.col("heuristic"), F.col("key"), F.col("n")
    count = n.cast("string")

    def pick(upstream, message, keyword, warnings):
        return (
            F.when(kind == UPSTREAM, upstream)
            .when(kind == MESSAGE, message)
            .when(kind == KEYWORD, keyword)
            .otherwise(warnings)
        )

    # The sentences of causes and evidence.
    cause = pick(
        F.concat(F.lit("Errors in upstream service '"), key, F.lit("'")),
        F.concat(F.lit("Recurring error: "), F.substring(key, 1, CAUSE_LENGTH)),
        F.concat(F.lit("Infrastructure issue: '"), key, F.lit("' detected")),
        F.lit("Warning spike preceding errors"),
    )
    confidence = pick(
        _confidence(n, *UPSTREAM_CONFIDENCE),
        _confidence(n, *MESSAGE_CONFIDENCE),
        _confidence(n, *KEYWORD_CONFIDENCE),
        F.lit(WARNING_CONFIDENCE),
    )
    evidence = pick(
        F.concat(count, F.lit(" error(s) from "), key, F.lit(" during incident window")),
        F.concat(count, F.lit(" occurrence(s)")),
        F.concat(count, F.lit(" error(s) mention '"), key, F.lit("'")),
        F.concat(count, F.lit(" warnings vs "), F.col("errors").cast("string"), F.lit(" errors")),
    )
    counts = (kind != ERRORS) & ((kind != WARNINGS) | (n > F.col("errors")))
    return best.where(counts).select(
        "heuristic",
        cause.alias("cause"),
        confidence.alias("confidence"),
        evidence.alias("evidence"),
        "n",
        "key",
        "errors",
    )


def upstream_errors(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None, strict: bool = False
) -> DataFrame:
    """Causes from errors of other services in the window."""
    return _one_kind(tally(logs, service, tr, sources, strict), UPSTREAM)


def recurring_messages(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None
) -> DataFrame:
    """Causes from the three most frequent error messages."""
    counts = tally(logs, service, tr, sources).where(F.col("heuristic") == MESSAGE)
    return _one_kind(counts.orderBy(F.col("n").desc(), "key").limit(TOP_MESSAGES), MESSAGE)


def infrastructure_keywords(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None
) -> DataFrame:
    """Causes from infrastructure words in error messages."""
    return _one_kind(tally(logs, service, tr, sources), KEYWORD)


def _one_kind(counts: DataFrame, kind: int) -> DataFrame:
    found = counts.where(F.col("heuristic") == kind).withColumn("errors", F.lit(0).cast("bigint"))
    return _as_causes(found).select("cause", "confidence", "evidence")


def warning_spike(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None
) -> DataFrame:
    """The cause "more warnings in the window than errors", or no row."""
    best = _best_evidence(
        tally(logs, service, tr, sources).where(F.col("heuristic").isin(WARNINGS, ERRORS))
    )
    return _as_causes(best).select("cause", "confidence", "evidence")


def rank_causes(
    logs: DataFrame, service: str, tr: TimeRange | None = None, sources=None, strict: bool = False
) -> DataFrame:
    """The five best causes, unique by text, with their rank."""
    causes = _as_causes(_best_evidence(tally(logs, service, tr, sources, strict)))
    order = [F.col("confidence").desc(), "heuristic", F.col("n").desc(), "key"]
    first = F.row_number().over(W.partitionBy("cause").orderBy(*order))
    unique = causes.withColumn("place", first).where(F.col("place") == 1)
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))
    return (
        unique.orderBy(*order)
        .limit(BEST_CAUSES)
        .select(rank.alias("rank"), "cause", "confidence", "evidence")
    )


def root_cause(
    logs: DataFrame,
    service: str,
    tr: TimeRange | None = None,
    symptom: str = "",
    sources=None,
    strict: bool = False,
) -> RootCause:
    """Report (service, symptom, error_count), ranked causes and timeline of an incident."""
    report = incident_errors(logs, service, tr, sources).agg(F.count("*").alias("error_count"))
    report = report.select(
        F.lit(service).alias("service"), F.lit(symptom).alias("symptom"), "error_count"
    )
    return RootCause(
        report,
        rank_causes(logs, service, tr, sources, strict),
        incident_context(logs, tr, sources),
    )
