"""Landed responses that are already aggregated, as (key, value, count) buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import number
from .exports import last_wins_entries

# Names a metric cell may have.
METRIC_CELLS = ("count()", "avg()", "sum()", "min()", "max()")
METRIC_PREFIX = "stats "

_DATADOG = "data variant"
_DATADOG_BUCKETS = "array<struct<by:map<string,string>, aggregations:array<struct<value:string>>>>"
_LOKI = (
    "data struct<resultType:string, result:array<struct<metric:map<string,string>, "
    "value:array<string>, values:array<array<string>>>>>"
)
_INSIGHTS = "results array<array<struct<field:string, value:string>>>"

KINDS = ("datadog", "loki", "insights")


def _count_of(value: Column) -> Column:
    """A whole number is its own count, anything else counts once."""
    return F.when(value == F.floor(value), value.cast("bigint")).otherwise(F.lit(1))


def _key(pairs: Column) -> Column:
    return F.coalesce(pairs, F.create_map().cast("map<string,string>"))


def normalize_buckets(responses: DataFrame, kind: str) -> DataFrame:
    """Buckets of the responses in `value`; a number that cannot be read is 0.0."""
    if kind == "datadog":
        return _datadog(responses)
    if kind == "loki":
        return _loki(responses)
    if kind == "insights":
        return _insights(responses)
    raise ValueError(f"kind must be one of {KINDS}: {kind!r}")


def _datadog(responses: DataFrame) -> DataFrame:
    """The last readable `value` of each bucket. `data` is the list or holds it as `buckets`."""
    data = F.from_json("value", f"struct<{_DATADOG}>")["data"]
    listed = F.coalesce(
        F.try_variant_get(data, "$.buckets", _DATADOG_BUCKETS),
        F.try_variant_get(data, "$", _DATADOG_BUCKETS),
    )
    bucket = responses.select(F.explode(listed).alias("bucket"))
    readable = F.filter(
        F.transform("bucket.aggregations", lambda a: number(a["value"])), lambda v: v.isNotNull()
    )
    last = F.try_element_at(readable, F.lit(-1))
    return bucket.select(_key(F.col("bucket.by")).alias("key"), last.alias("last")).select(
        "key",
        F.coalesce("last", F.lit(0.0)).alias("value"),
        F.when(F.col("last").isNull(), F.lit(0)).otherwise(_count_of(F.col("last"))).alias("count"),
    )


def _loki(responses: DataFrame) -> DataFrame:
    """Vector: the sample itself. Matrix: sum and number of the samples; empty series are left out."""
    data = responses.select(F.from_json("value", f"struct<{_LOKI}>")["data"].alias("data"))
    series = data.select(F.col("data.resultType").alias("shape"), F.explode("data.result").alias("s"))
    single = F.coalesce(number(F.try_element_at("s.value", F.lit(2))), F.lit(0.0))
    samples = F.transform("s.values", lambda v: number(F.try_element_at(v, F.lit(2))))
    total = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v)
    vector = F.col("shape") == "vector"
    return (
        series.where(vector | ((F.col("shape") == "matrix") & (F.size("s.values") > 0)))
        .select(
            _key(F.col("s.metric")).alias("key"),
            F.when(vector, single).otherwise(F.coalesce(total, F.lit(0.0))).alias("value"),
            F.when(~vector, F.size("s.values").cast("bigint")).alias("samples"),
        )
        .select("key", "value", F.coalesce("samples", _count_of(F.col("value"))).alias("count"))
    )


def _insights(responses: DataFrame) -> DataFrame:
    """The last metric cell; if that gives nothing, the first other cell that is a number."""
    row = responses.select(F.explode(F.from_json("value", f"struct<{_INSIGHTS}>")["results"]).alias("cells"))

    def is_metric(cell):
        return cell["field"].isin(*METRIC_CELLS) | cell["field"].startswith(METRIC_PREFIX)

    metrics = F.filter("cells", is_metric)
    others = F.transform(
        F.filter("cells", lambda c: ~is_metric(c)),
        lambda c: F.struct(c["field"].alias("key"), F.coalesce(c["value"], F.lit("")).alias("value")),
    )
    metric = F.coalesce(number(F.try_element_at(metrics, F.lit(-1))["value"]), F.lit(0.0))
    numeric = F.filter(
        F.transform(others, lambda c: number(c["value"])), lambda v: v.isNotNull()
    )
    spare = F.try_element_at(numeric, F.lit(1))
    return (
        row.select(last_wins_entries(others).alias("key"), metric.alias("metric"), spare.alias("spare"))
        .select(
            "key",
            F.when(F.col("metric") != 0, F.col("metric"))
            .otherwise(F.coalesce("spare", F.lit(0.0)))
            .alias("value"),
        )
        .select("key", "value", _count_of(F.col("value")).alias("count"))
    )
