"""Reading JSON that a model wrote: fences, strict parsing, shape checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, col

_END = "end of text"


def strip(value) -> Column:
    """Trim Unicode white space on both sides; only the ends of the text are looked at."""
    return F.btrim(col(value), F.lit(SPACES))


def unfence(value) -> Column:
    """The content between a leading ``` line and the last ``` of the text."""
    fenced = r"(?s)\A```[^\n]*\n(?:(.*)```.*|(.*))\z"
    return F.regexp_replace(strip(F.coalesce(col(value), F.lit(""))), fenced, "$1$2")


def json_value(text) -> Column:
    """The text as one JSON value, or null. Text after the value is an error.

    The parser stops after the first value, so the text is read as the first of
    two array items; only then does anything left over show up as a wrong size.
    """
    both = F.try_parse_json(F.concat(F.lit("["), col(text), F.lit(f',"{_END}"]')))
    items = F.array(F.try_variant_get(both, "$", "array<variant>"))

    def first(pair: Column) -> Column:
        whole = (F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == _END)
        return F.when(whole, F.get(pair, F.lit(0)))

    # A lambda names the parsed items, so that the text is parsed once.
    return F.get(F.transform(items, first), F.lit(0))


def shape_of(value: Column) -> Column:
    """``array``, ``object``, a scalar's type name, or ``invalid``."""
    return F.lower(F.substring_index(F.coalesce(F.schema_of_variant(value), F.lit("INVALID")), "<", 1))


def field(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def is_string(value: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(field(value, name, "variant")) == "STRING", F.lit(False))


def is_array(value: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(field(value, name, "variant")).startswith("ARRAY"), F.lit(False))


def truthy(value: Column) -> Column:
    """Whether a value counts as set: not missing, null, false, zero or empty."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    # A text "0" is set, a number 0 is not; only such cases look at the type.
    unclear = text.isin("", "0", "0.0", "false", "[]", "{}")
    return F.when(unclear, (text != "") & (F.schema_of_variant(value) == "STRING")).otherwise(True)
