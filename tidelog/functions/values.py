"""Text of dynamic values: numbers, maps with repeated keys, rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """Finite number written in `text`, else null. The pattern keeps out `1d`, `NaN`, `true`."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, however often `use` mentions it.

    The one element of an array is bound to a lambda variable. Worth it for parsing calls, which
    the optimiser would repeat at every mention inside one expression.
    """
    return F.transform(F.array(value), use)[0]


def last_wins(pairs: Column) -> Column:
    """Map in which a repeated key keeps its last value, whatever the session's policy is."""

    def clean(entries):
        def is_last(entry, i):
            tail = F.slice(entries, i + 2, F.size(entries))
            return ~F.exists(tail, lambda other: other["key"] == entry["key"])

        return F.map_from_entries(F.filter(entries, is_last))

    keys = F.map_keys(pairs)
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeated, clean(F.map_entries(pairs))).otherwise(pairs)


def overlay(base: Column, top: Column) -> Column:
    """Union of two maps of the same type, `top` winning; a null map counts as empty."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(top), k))
    return (
        F.when(base.isNull(), top).when(top.isNull(), base).otherwise(F.map_concat(kept, top))
    )


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def two_decimals(value: Column) -> Column:
    """Plain text with one or two decimals, never an exponent: 100.0, 66.67, 12.5."""
    return F.regexp_replace(value.cast("decimal(38,2)").cast("string"), "0$", "")


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent, two decimals; from nothing to something is infinite."""
    change = F.round((after - before) / F.when(before != 0, before).cast("double") * 100, 2)
    return (
        F.when((before == 0) & (after > 0), F.lit(float("inf")))
        .when(before == 0, F.lit(0.0))
        .otherwise(change)
    )
