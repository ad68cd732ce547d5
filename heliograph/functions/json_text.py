"""JSON text as VARIANT: strict readability and shape-tolerant access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def allow_repeated_keys(spark: SparkSession) -> None:
    """A repeated key is valid JSON (the last one counts), so parsing must not reject it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: Stands behind a text inside the brackets in which it is parsed; a text that ends them itself leaves it unread.
_END = "end of text 5d1f2a"


def readable(text: str) -> Column:
    """The VARIANT of a string column, or null unless the *whole* string is one JSON value.

    The parser stops behind the first value, so text that follows would pass
    unseen. Parsed inside brackets and before an end mark, such text breaks
    the array, adds elements, or leaves the mark unread.
    """
    whole = f"try_variant_get(w, '$[1]', 'string') = '{_END}' AND try_variant_get(w, '$[2]', 'variant') IS NULL"
    return F.expr(f"try_element_at(transform(array(try_parse_json(concat('[', `{text}`, ',\"{_END}\"]'))), w -> CASE WHEN {whole} THEN try_variant_get(w, '$[0]', 'variant') END), 1)")


def only_readable(df: DataFrame, text: str, *keep: Column | str, to: str = "v") -> DataFrame:
    """``keep`` and the VARIANT of readable texts, rows of others left out.

    A filter on the parsed value would be pushed below it and parse every text
    twice; a generator of none or one value isn't.
    """
    return df.select(*keep, F.explode(F.filter(F.array(readable(text)), lambda v: v.isNotNull())).alias(to))


def opened_map(variant: str) -> Column:
    """The members of an object, or of the object that a string contains, as map<string,variant>; null for any other value."""
    text = f"CASE WHEN schema_of_variant({variant}) = 'STRING' THEN try_variant_get(try_parse_json(variant_get({variant}, '$', 'string')), '$', 'map<string,variant>') END"
    return F.expr(f"coalesce(try_variant_get({variant}, '$', 'map<string,variant>'), {text})")


def as_map(variant: str) -> Column:
    """An object's members as map<string,variant>; null for any other value."""
    return F.expr(f"try_variant_get({variant}, '$', 'map<string,variant>')")


def as_array(variant: str) -> Column:
    """An array's elements; null for any other value."""
    return F.expr(f"try_variant_get({variant}, '$', 'array<variant>')")


def opened(variant: str) -> Column:
    """A string value that contains JSON, parsed; any other value as it is.

    The shallow look for an object comes first: ``schema_of_variant`` walks all of a value.
    """
    text = f"CASE WHEN schema_of_variant({variant}) = 'STRING' THEN try_parse_json(variant_get({variant}, '$', 'string')) ELSE {variant} END"
    return F.expr(f"CASE WHEN try_variant_get({variant}, '$', 'map<string,variant>') IS NOT NULL THEN {variant} ELSE {text} END")
