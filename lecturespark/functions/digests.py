"""Canonical digests and checked base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted names; nulls stay in."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_digest(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def strict_base64(value) -> Column:
    """The decoded bytes, or null if the text is not exact base64."""
    text = col(value)
    exact = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(exact, F.try_to_binary(text, F.lit("base64")))


def envelope_status(ciphertext, digest) -> Column:
    """Whether an envelope's text is base64 and has the declared digest."""
    raw = strict_base64(F.coalesce(col(ciphertext), F.lit("")))
    return (F.when(raw.isNull(), "not_base64")
            .when(F.sha2(raw, 256) != F.coalesce(col(digest), F.lit("")), "checksum_mismatch").otherwise("ok"))
