"""Cutting recordings into decode chunks and recogniser windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_present

CHUNK_SECONDS = 600
WINDOW_SECONDS = 30
SAMPLE_RATE = 16_000
MAX_SECONDS = 12 * 3600


def recording_error(start: str = "start_seconds", duration: str = "duration_seconds"):
    return (F.when(first_present(start) < 0, "invalid_start")
            .when(~F.coalesce(F.col(duration).between(0, MAX_SECONDS) & (F.col(duration) > 0), F.lit(False)), "invalid_duration"))


def chunk_grid(recordings: DataFrame, keys: list[str]) -> DataFrame:
    """Ten-minute chunks that cover a recording whole; a refused one is a row with its ``recording_error``."""
    read = recordings.select(*keys, first_present("start_seconds").cast("double").alias("_start"),
                             F.col("duration_seconds").cast("double").alias("_d"), recording_error().alias("recording_error"))
    last = F.when(F.col("recording_error").isNull(), F.ceil(F.col("_d") / CHUNK_SECONDS).cast("bigint") - 1)
    chunks = read.select("*", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_id"))
    offset = F.col("chunk_id") * CHUNK_SECONDS
    rest = F.when(offset.isNotNull(), F.least(F.lit(float(CHUNK_SECONDS)), F.col("_d") - offset))
    return chunks.select(*keys, "chunk_id", (F.col("_start") + offset).alias("offset_seconds"), rest.alias("duration_seconds"), "recording_error")


def window_grid(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Thirty-second windows of a chunk's samples; ``short`` marks a rest under half a second."""
    size = SAMPLE_RATE * WINDOW_SECONDS
    last = F.floor((F.col("samples") - 1) / size).cast("bigint")
    starts = chunks.where("samples > 0").withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("window_id") * size
    end = F.least(F.col("samples").cast("bigint"), first + size)
    base = F.floor(F.col("offset_seconds") * 1000).cast("bigint")
    ms = lambda s: base + F.floor(s * 1000 / SAMPLE_RATE).cast("bigint")
    return starts.select(*keys, "window_id", ms(first).alias("start_ms"), ms(end).alias("end_ms"), (end - first < SAMPLE_RATE // 2).alias("short"))
