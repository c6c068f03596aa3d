"""Streaming forms: following, windowed counts, sessions, anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timeexpr import micros, parse_width, parse_window
from ..operators.aggregate import BUCKET, group_key, metric_value, numeric_field
from ..operators.correlate import group_score
from ..operators.detect import score_points
from ..operators.predicates import filter_logs, search
from ..schema import is_alarm


def _interval(width) -> str:
    return f"{micros(width)} microseconds"


def follow(stream: DataFrame, query: str = "", **conditions) -> DataFrame:
    """New entries that match a search and structured conditions, for append output."""
    return filter_logs(search(stream, query), **conditions)


def follow_aggregate(
    stream: DataFrame,
    group_by=(),
    width: str = "5m",
    lateness: str = "10m",
    metric: str = "count",
    field: str | None = None,
) -> DataFrame:
    """Live counts per fixed-width bin and key; entries later than the watermark are dropped."""
    span = _interval(parse_width(width))
    value = metric_value(metric, numeric_field(field) if field else None)
    counted = (
        stream.where(F.col("ts").isNotNull())
        .withWatermark("ts", _interval(parse_width(lateness)))
        .groupBy(F.window("ts", span), *[group_key(n).alias(n) for n in group_by])
        .agg(value.alias("value"), F.count("*").alias("count"))
    )
    return counted.select(F.col("window.start").alias(BUCKET), *group_by, "value", "count")


def follow_correlate(
    stream: DataFrame, window: str = "5m", by: str = "service", lateness: str = "10m"
) -> DataFrame:
    """Live chains of close entries per service or trace, for append or complete output.

    Entries without the key form no chain. With the settings of this package sessions are merged
    inside each task before the shuffle, which keeps a hot key small.
    """
    gap = _interval(parse_window(window))
    counted = (
        stream.where(F.col("ts").isNotNull() & F.col(by).isNotNull())
        .withWatermark("ts", _interval(parse_width(lateness)))
        .groupBy(F.session_window("ts", gap).alias("session"), by)
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count("*").alias("entries"),
            F.count_if(is_alarm()).alias("alarms"),
        )
    )
    score = group_score(F.col("alarms"), F.col("entries"))
    return counted.select(by, "start_ts", "end_ts", "entries", score.alias("score"))


def follow_anomalies(
    stream: DataFrame,
    model: DataFrame,
    by=("source",),
    bucket: str = "1h",
    lateness: str = "10m",
    sensitivity: str = "medium",
) -> DataFrame:
    """Live volume per bucket and key, scored against a model from `anomaly_model` with these keys.

    The model has one row per key and should be a written table, see `keep_model`; Spark
    broadcasts it only if its size allows.
    """
    if not by:
        raise ValueError("name the keys of the model, for example source")
    points = follow_aggregate(stream, by, bucket, lateness).drop("count")
    return score_points(points.join(model, list(by)), sensitivity)
