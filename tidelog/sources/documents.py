"""A parsed log document: its keys with text and with the knowledge whether the text was a string.

Every format becomes `map<string, struct<text, is_text>>` first, so that one set of rules turns
JSON objects, regex groups and backend payloads into entries.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.values import bind, last_wins
from ..schema import SEARCH_SEPARATOR

# JSON values that count as absent for ids and names.
FALSY_TEXT = ("", "0", "0.0", "-0.0", "false", "{}", "[]")

JSON_OPTIONS = {"allowSingleQuotes": "false"}


def json_object(text: Column) -> Column:
    """`map<string,variant>` if the whole text is one JSON object, else null.

    The text is read as the only element of an array, which refuses whatever follows the object.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.when(
        F.rtrim(text).endswith("}"),
        F.from_json(wrapped, "array<map<string,variant>>", JSON_OPTIONS),
    )
    return bind(parsed, lambda found: F.when(F.size(found) == 1, found[0]))


def is_json(text: Column) -> Column:
    """True if the whole text is one JSON value of any kind."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(wrapped, "array<variant>", JSON_OPTIONS)
    return F.coalesce(F.size(parsed) == 1, F.lit(False))


def document(variants: Column) -> Column:
    """Non-null keys of a `map<string,variant>` with their text."""

    def described(found):
        present = F.map_filter(
            last_wins(found), lambda _, v: v.isNotNull() & ~F.is_variant_null(v)
        )
        return F.transform_values(
            present,
            lambda _, v: F.struct(
                v.cast("string").alias("text"),
                (F.schema_of_variant(v) == "STRING").alias("is_text"),
            ),
        )

    return bind(variants, described)


def text_document(pairs: Column) -> Column:
    """Document of a `map<string,string>`; nulls are left out."""
    present = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return F.transform_values(
        present, lambda _, v: F.struct(v.alias("text"), F.lit(True).alias("is_text"))
    )


def text_of(doc: Column, key: str) -> Column:
    return doc[key]["text"]


def truthy(doc: Column, *keys: str) -> Column:
    """Text of the first of `keys` whose value is not empty, zero, false or an empty container."""

    def one(key):
        value = doc[key]
        empty = (value["text"] == "") | (~value["is_text"] & value["text"].isin(*FALSY_TEXT))
        return F.when(~empty, value["text"])

    return F.coalesce(*[one(k) for k in keys])


def without(doc: Column, keys) -> Column:
    return F.map_filter(doc, lambda k, _: ~k.isin(*keys))


def fields_of(doc: Column) -> Column:
    return F.transform_values(doc, lambda _, v: v["text"])


def search_text(message: Column, service: Column, host: Column, doc: Column | None = None) -> Column:
    """Lower-cased text that search looks into: message, service, host and string fields."""
    parts = [message, service, host]
    if doc is not None:
        strings = F.filter(F.map_values(doc), lambda v: v["is_text"])
        parts.append(F.transform(strings, lambda v: v["text"]))
    return F.lower(F.concat_ws(SEARCH_SEPARATOR, *parts))
