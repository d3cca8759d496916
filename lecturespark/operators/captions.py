"""SRT and WebVTT captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock
from .scan import document_parts
from .segments import normalise_segments

CUES_PER_PART = 2000


def _captions(df: DataFrame, keys: list[str], header: str, cue, per_part: int, options: dict) -> DataFrame:
    cues = normalise_segments(df, keys, **options).select(*keys, "ord", cue.alias("piece"))
    # One header piece per lecture also keeps lectures whose segments are all blank.
    heads = df.select(*keys).distinct().select(
        *keys, F.lit(-1).cast("bigint").alias("ord"), F.lit(header).alias("piece"))
    return document_parts(cues.unionByName(heads), keys, "ord", "piece", per_part)


def captions_srt(df: DataFrame, keys: list[str] | None = None, per_part: int = CUES_PER_PART, **options) -> DataFrame:
    """Segments to SRT text, one row per lecture and part.

    A cue carries its own blank line, so the parts of a lecture join by plain
    concatenation and a lecture without cues is the empty text.
    """
    gap = F.when(F.col("ord") > 0, "\n").otherwise("")
    cue = F.concat(gap, (F.col("ord") + 1).cast("string"), F.lit("\n"), clock("start_ms", ","),
                   F.lit(" --> "), clock("end_ms", ","), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _captions(df, keys or ["lecture_id"], "", cue, per_part, options)


def captions_vtt(df: DataFrame, keys: list[str] | None = None, per_part: int = CUES_PER_PART, **options) -> DataFrame:
    """Segments to WebVTT text, one row per lecture and part."""
    cue = F.concat(F.lit("\n"), clock("start_ms", "."), F.lit(" --> "), clock("end_ms", "."),
                   F.lit("\n"), F.col("text"), F.lit("\n"))
    return _captions(df, keys or ["lecture_id"], "WEBVTT\n", cue, per_part, options)


def write_captions(parts: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write caption parts as text files, one folder per lecture, parts in order.

    Large lectures spread over several files: rows are ranged by (lecture, part),
    and file order within a folder is part order. The writer ends every row with the
    line break each part ends with; a text of no cues has no file.
    """
    keys = keys or ["lecture_id"]
    lines = parts.where("text <> ''").withColumn("text", F.expr("left(text, length(text) - 1)"))
    (lines.repartitionByRange(*keys, "part").sortWithinPartitions(*keys, "part")
     .select(*keys, "text").write.mode("overwrite").partitionBy(*keys).text(path))
