"""Keyword tags of questions asked in English, as columns over any text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Level words, looked for in this order.
LEVELS = ("error", "warn", "info")

# What stands before a service name or a host name, looked for in this order.
SERVICE_PREFIXES = ("service:", "from service ", "in service ")
HOST_PREFIXES = ("host:",)

# Phrases and the range they mean; the first rule that applies wins.
RANGE_PHRASES = (
    ("1h", ("last hour", "past hour", "1 hour")),
    ("30m", ("last 30 minutes", "30 minutes", "half hour")),
    ("5m", ("last 5 minutes", "5 minutes")),
    ("24h", ("last 24 hours", "past day", "1 day")),
    ("7d", ("last week", "past week", "1 week")),
)
DEFAULT_RANGE = "1h"

# Words that are never a keyword.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would shall should can could
may might must show me find get all from in for with about and or but not no yes to of on at by
this that these those i you he she it we they my your his her its our their what which who when
where why how logs log service host error warn warning info level
""".split()
KEYWORD_LENGTH = 4

_BLANK = r"(?U)[\s\x1c-\x1f]"
_WORD_AFTER = r"(?U)[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)"


def _contains_any(text: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def tag_level(text: Column) -> Column:
    """The first of error, warn and info that occurs in the text."""
    lowered = F.lower(text)
    tag = F.when(F.lit(False), F.lit(""))
    for word in LEVELS:
        tag = tag.when(lowered.contains(word), F.lit(word))
    return tag


def _word_after(text: Column, prefixes) -> Column:
    """Word after the first prefix of the list that occurs; null if nothing follows it."""
    lowered = F.lower(text)
    tag = F.when(F.lit(False), F.lit(""))
    for prefix in prefixes:
        word = F.regexp_extract(lowered, prefix + _WORD_AFTER, 1)
        tag = tag.when(lowered.contains(prefix), F.when(word != "", word))
    return tag


def tag_service(text: Column) -> Column:
    return _word_after(text, SERVICE_PREFIXES)


def tag_host(text: Column) -> Column:
    return _word_after(text, HOST_PREFIXES)


def tag_time_range(text: Column) -> Column:
    """Range meant by the first phrase rule that applies, 1h if none does."""
    lowered = F.lower(text)
    tag = F.when(F.lit(False), F.lit(""))
    for span, phrases in RANGE_PHRASES:
        tag = tag.when(_contains_any(lowered, phrases), F.lit(span))
    return tag.otherwise(F.lit(DEFAULT_RANGE))


def tag_keyword(text: Column) -> Column:
    """First word of more than three characters that is not a stop word, as it is written."""
    words = F.split(text, _BLANK + "+")
    kept = F.filter(
        words, lambda w: (F.length(w) >= KEYWORD_LENGTH) & ~F.lower(w).isin(*STOP_WORDS)
    )
    return F.try_element_at(kept, F.lit(1))


def tag_questions(df: DataFrame, column: str = "text") -> DataFrame:
    """All tags of a text column next to the other columns."""
    text = F.col(column)
    return df.select(
        "*",
        tag_level(text).alias("level"),
        tag_service(text).alias("service"),
        tag_host(text).alias("host"),
        tag_time_range(text).alias("time_range"),
        tag_keyword(text).alias("keyword"),
    )
