"""Recurring error templates and unusual buckets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import template
from ..functions.timeexpr import UTC, TimeRange, micros, parse_width
from ..functions.timestamps import epoch_bucket
from ..schema import is_alarm
from .aggregate import BUCKET, group_key, numeric_field
from .predicates import filter_logs, in_time_range
from .reuse import never_null, whole_rows

SAMPLES = 3

# How many standard deviations count as unusual.
THRESHOLDS = {"low": 3.0, "medium": 2.0, "high": 1.5}

METRICS = ("log_volume", "error_rate", "latency")

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

# Buckets written out by one task when a series is filled.
FILL_RUN = 4096


def error_entries(
    logs: DataFrame, tr: TimeRange | None = None, service: str | None = None
) -> DataFrame:
    return filter_logs(logs, level="ERROR", service=service, tr=tr)


def total_errors(
    logs: DataFrame, tr: TimeRange | None = None, service: str | None = None
) -> DataFrame:
    return error_entries(logs, tr, service).agg(F.count("*").alias("total_errors"))


def detect_error_patterns(
    logs: DataFrame,
    tr: TimeRange | None = None,
    service: str | None = None,
    min_occurrences: int = 5,
) -> DataFrame:
    """Templates of error messages seen at least `min_occurrences` times.

    Columns: pattern, count, sample_messages (the three smallest distinct ones), first_seen,
    last_seen, services (sorted). Errors are folded per (service, message) first, which both the
    counts and the samples read, so a repeated message is masked once. Samples are cut to three per template inside every
    task, so a template with most of the rows stays small.
    """
    errors = error_entries(logs, tr, service)
    folded = errors.groupBy("service", "message").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    folded = whole_rows(folded).withColumn("pattern", template(F.col("message")))
    # Distinct services of a template are few; its messages may be as many as the errors.
    per_service = folded.groupBy("pattern", "service").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    patterns = (
        per_service.groupBy("pattern")
        .agg(
            F.sum("n").alias("count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sort_array(F.collect_set("service")).alias("services"),
        )
        .where(F.col("count") >= min_occurrences)
    )
    place = F.dense_rank().over(W.partitionBy("pattern").orderBy("message"))
    samples = (
        folded.withColumn("place", place)
        .where(F.col("place") <= SAMPLES)
        .groupBy("pattern", "message")
        .agg(F.count("*").alias("services"))
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_list("message")).alias("sample_messages"))
    )
    return patterns.join(samples, "pattern").select(
        "pattern", "count", "sample_messages", "first_seen", "last_seen", "services"
    )


def metric_series(
    logs: DataFrame,
    metric: str = "log_volume",
    bucket: str = "1h",
    by=(),
    field: str = "latency",
    tr: TimeRange | None = None,
) -> DataFrame:
    """Value per bucket that has entries, and per key of `by`."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}: {metric!r}")
    width = parse_width(bucket)
    timed = in_time_range(logs, tr).where(F.col("ts").isNotNull())
    if metric == "latency":
        timed = timed.where(numeric_field(field).isNotNull())
        value = F.avg(numeric_field(field))
    elif metric == "error_rate":
        value = F.count_if(is_alarm()) / F.count("*")
    else:
        value = F.count("*").cast("double")
    start = never_null(epoch_bucket(F.col("ts"), width), EPOCH).alias(BUCKET)
    series = timed.groupBy(*[group_key(n).alias(n) for n in by], start).agg(value.alias("value"))
    return whole_rows(series)


def series_model(series: DataFrame, by: list[str], step: int | None) -> DataFrame:
    """Mean and sample standard deviation of each series, with its first and last bucket.

    Given a bucket width, the buckets between them that have no entry count as zeros. They enter by their number,
    which the span tells, and are not written out: a stray time far from the others costs nothing.
    """
    at = F.unix_micros(BUCKET)
    found = series.groupBy(*by).agg(
        F.count("value").alias("seen"),
        F.avg("value").alias("seen_mean"),
        F.var_pop("value").alias("seen_var"),
        F.min(at).alias("low"),
        F.max(at).alias("high"),
    )
    seen = F.col("seen")
    n = seen if step is None else F.call_function("div", F.col("high") - F.col("low"), F.lit(step)) + 1
    found = found.withColumn("n", n).withColumn("mean", F.col("seen_mean") * seen / F.nullif("n", F.lit(0)))
    # Squared distances from the mean: of the seen values, and of the zeros.
    off = F.col("seen_mean") - F.col("mean")
    squares = seen * (F.col("seen_var") + off * off) + (F.col("n") - seen) * F.col("mean") * F.col("mean")
    stddev = F.when(F.col("n") > 1, F.sqrt(squares / F.nullif(F.col("n") - 1, F.lit(0))))
    return found.select(*by, "mean", stddev.alias("stddev"), "low", "high")


def empty_buckets(series: DataFrame, spans: DataFrame, step: int) -> DataFrame:
    """Zero rows, with the columns of `spans`, for its buckets from `low` to `high` that the series has not.

    A long span is written out in runs that are spread over the tasks, never by one row alone.
    """
    keys = [c for c in spans.columns if c not in ("low", "high", "mean", "stddev")]
    runs = spans.withColumn("run", F.explode(F.sequence("low", "high", F.lit(step * FILL_RUN))))
    runs = runs.repartition(*keys, "run")
    end = F.least(F.col("run") + F.lit(step * (FILL_RUN - 1)), F.col("high"))
    grid = runs.withColumn("at", F.explode(F.sequence("run", end, F.lit(step))))
    grid = grid.select(*keys, F.timestamp_micros("at").alias(BUCKET), F.lit(0.0).alias("value"), "mean", "stddev")
    return grid.join(series, [*keys, BUCKET], "left_anti")


def anomaly_model(
    logs: DataFrame,
    metric: str = "log_volume",
    bucket: str = "1h",
    by=(),
    field: str = "latency",
    tr: TimeRange | None = None,
) -> DataFrame:
    """Mean and sample standard deviation of the series, one row per key of `by`."""
    series = metric_series(logs, metric, bucket, by, field, tr)
    return series_model(series, list(by), zero_step(metric, bucket)).drop("low", "high")


def zero_step(metric: str, bucket: str) -> int | None:
    """Bucket width of a metric in which a bucket without entries is a zero; None where it is a gap."""
    return micros(parse_width(bucket)) if metric == "log_volume" else None


def deviation_score(actual: Column, mean: Column, stddev: Column, sensitivity: str) -> Column:
    """Distance from the mean in thresholds; above 1 is unusual, null without any spread."""
    if sensitivity not in THRESHOLDS:
        raise ValueError(f"sensitivity must be one of {tuple(THRESHOLDS)}: {sensitivity!r}")
    spread = F.when(stddev > 0, stddev)
    return F.abs((actual - mean) / spread) / F.lit(THRESHOLDS[sensitivity])


def score_points(points: DataFrame, sensitivity: str) -> DataFrame:
    """Unusual rows of `points` (value, mean, stddev and keys) in the result layout."""
    keys = [c for c in points.columns if c not in ("value", "mean", "stddev")]
    score = deviation_score(F.col("value"), F.col("mean"), F.col("stddev"), sensitivity)
    return points.withColumn("deviation_score", score).where(F.col("deviation_score") > 1).select(
        *keys,
        F.col("mean").alias("expected_value"),
        F.col("value").alias("actual_value"),
        "deviation_score",
    )


def find_anomalies(
    logs: DataFrame,
    tr: TimeRange | None = None,
    metric: str = "log_volume",
    sensitivity: str = "medium",
    bucket: str = "1h",
    by=(),
    field: str = "latency",
) -> DataFrame:
    """Buckets whose value is further from the mean than the sensitivity allows."""
    series = metric_series(logs, metric, bucket, by, field, tr)
    keys, step = list(by), zero_step(metric, bucket)
    model = series_model(series, keys, step)
    if keys:
        points = series.join(model.drop("low", "high"), keys)
    else:
        one = model.select(F.struct("mean", "stddev").alias("m")).scalar()
        points = series.withColumn("m", one).select(
            BUCKET, "value", F.col("m.mean").alias("mean"), F.col("m.stddev").alias("stddev")
        )
    points = points.select(*keys, BUCKET, "value", "mean", "stddev")
    if step is not None:
        # Zeros are written out only where a zero is unusual. That needs a mean above 1.5 standard deviations, so
        # by Cantelli's inequality fewer than one bucket in three is a zero there: the zeros stay fewer than the rows.
        zero = deviation_score(F.lit(0.0), F.col("mean"), F.col("stddev"), sensitivity)
        points = points.unionByName(empty_buckets(series, model.where(zero > 1), step))
    return score_points(points, sensitivity)
