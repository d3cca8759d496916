"""Text and time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space; the separators U+001C to U+001F are not in Java's \s.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
# The same characters one by one.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value) -> Column:
    """Collapse white space and trim; a missing text becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), BLANKS, " "))


def clean_asr_text(value) -> Column:
    """As ``clean_text``, without the silence marks a recogniser writes."""
    return clean_text(F.replace(F.coalesce(col(value), F.lit("")), F.lit("<sil>"), F.lit("")))


def present(value, missing=0) -> Column:
    """Null for the values that count as missing: null, zero or the empty string."""
    return F.nullif(col(value), F.lit(missing))


def first_present(*values, missing=0, default=None) -> Column:
    picks = [present(v, missing) for v in values]
    return F.coalesce(*picks, F.lit(missing if default is None else default))


def int_div(value, by: int) -> Column:
    """Whole-number division that rounds down, also below zero."""
    value = col(value)
    return ((value - F.pmod(value, F.lit(by).cast("bigint"))) / by).cast("bigint")


def digits(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def clock(ms, separator: str) -> Column:
    """``HH:MM:SS,mmm``; negative times are zero, hours may pass 99."""
    value = F.greatest(col(ms).cast("bigint"), F.lit(0).cast("bigint"))
    seconds, minutes = int_div(value, 1000), int_div(value, 60_000)
    return F.concat(
        digits(int_div(value, 3_600_000), 2), F.lit(":"),
        digits(F.pmod(minutes, F.lit(60)), 2), F.lit(":"),
        digits(F.pmod(seconds, F.lit(60)), 2), F.lit(separator),
        digits(F.pmod(value, F.lit(1000)), 3),
    )
