"""Message text: stripping, level words, error templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as blank at the ends of a line.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Level words in the order they are looked for.
LEVEL_WORDS = ("ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE")

# What varies inside an error message, most specific first.
TEMPLATE_PARTS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<IP>"),
    (r"\b(0[xX][0-9a-fA-F]+|[0-9a-fA-F]{8,})\b", "<HEX>"),
    (r"[0-9]+", "<NUM>"),
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def infer_level(message: Column) -> Column:
    """First level word that starts the line or stands between spaces; WARNING reads as WARN."""
    upper = F.upper(message)
    found = F.when(F.lit(False), F.lit(""))
    for word in LEVEL_WORDS:
        hit = upper.startswith(word) | upper.contains(f" {word} ")
        found = found.when(hit, F.lit("WARN" if word == "WARNING" else word))
    return found.otherwise(F.lit("UNKNOWN"))


def template(message: Column) -> Column:
    """The message with its varying parts masked."""
    for pattern, mask in TEMPLATE_PARTS:
        message = F.regexp_replace(message, pattern, mask)
    return message
