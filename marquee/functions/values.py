"""Scalar parsing of JSON, booleans, numbers and arrays. Bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import stripped


def variant_scalar(doc: Column, path: str) -> Column:
    """Scalar at `path` of a parsed variant as text; NULL for objects, arrays and JSON null."""
    part = F.try_variant_get(doc, path, "variant")
    nested = F.schema_of_variant(part).rlike("^(OBJECT|ARRAY)")
    return F.when(~F.coalesce(nested, F.lit(False)), F.try_variant_get(doc, path, "string"))


def json_value(text: Column, path: str) -> Column:
    """Scalar at `path` of a JSON text. For many paths parse once and use `variant_scalar`."""
    return variant_scalar(F.try_parse_json(text), path)


def parse_bool(value: Column) -> Column:
    word = F.lower(stripped(value.cast("string")))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def first_or_null(items: Column) -> Column:
    return F.get(items, 0)
