"""Cleaning and normalising timed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, first_present, present
from .scan import OrderedRows, Running

MIN_SEGMENT_MS = 200
DEFAULT_SEGMENT_MS = 1000


def clean_segments(df: DataFrame, text=clean_text) -> DataFrame:
    """Clean the text and drop blank segments (narrow, no shuffle)."""
    return df.withColumn("text", text("text")).where(F.col("text") != "")


def normalise_segments(df: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Order segments by start and push them apart so that none overlap.

    Segment i starts at max(e[i-1], s[i]) and ends at e[i] = max(e[i-1] + d[i], c[i]),
    where d is the shortest allowed length and c the end it would have alone. With
    D[i] the running sum of d this is e[i] = D[i] + max(0, max over j <= i of c[j] - D[j]):
    a running sum and a running maximum over one order, no row-by-row loop.
    ``ord`` comes back as the dense position in the cleaned list.
    """
    keys = keys or ["lecture_id"]
    start = first_present("start_ms")
    missing = present("end_ms").isNull()
    shortest = F.when(missing, DEFAULT_SEGMENT_MS).otherwise(MIN_SEGMENT_MS).cast("bigint")
    alone = F.when(missing, start + DEFAULT_SEGMENT_MS).otherwise(
        F.greatest(start + MIN_SEGMENT_MS, F.col("end_ms")))
    rows = clean_segments(df.select(*keys, "ord", "start_ms", "end_ms", "text")).select(
        *keys, "ord", "text", start.cast("bigint").alias("_s"),
        shortest.alias("_d"), alone.cast("bigint").alias("_c"))
    # Measured before cleaning, so that the count reads the keys and no text.
    rows = OrderedRows(rows, keys, ["_s", "ord"], **{"sized_by": df, **options})
    rows = rows.running(_length=Running("sum", F.col("_d")),
                        _n=Running("sum", F.lit(1).cast("bigint"), exclusive=True))
    rows = rows.derive(_lift=F.col("_c") - F.col("_length"))
    rows = rows.running(_before=Running("max", F.col("_lift"), exclusive=True))
    zero = F.lit(0).cast("bigint")
    return rows.result().select(
        *keys, F.col("_n").alias("ord"),
        F.greatest("_s", F.col("_length") - F.col("_d") + F.greatest(zero, "_before")).alias("start_ms"),
        (F.col("_length") + F.greatest(zero, "_before", "_lift")).alias("end_ms"),
        "text",
    )


def recogniser_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Segments and characters produced by each recogniser."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.length("text")).cast("bigint").alias("characters"))
