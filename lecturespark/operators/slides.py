"""Slides: source rows, page numbers, fingerprints and transcript windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_json import strip
from ..functions.text import first_present, present
from .align import window_of
from .intervals import join_points_to_intervals
from .scan import document_parts, list_positions

SEGMENTS_PER_WINDOW = 120
SLIDES_PER_WINDOW = 20
LINES_PER_PART = 10_000


def slide_rows(df: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Slides whose JSON content names an image, numbered over the kept rows."""
    keys = keys or ["lecture_id"]
    image = F.from_json(F.coalesce("content", F.lit("{}")), "pptimgurl STRING")["pptimgurl"]
    kept = df.select(*keys, "ord", first_present("created_sec").cast("bigint").alias("created_sec"),
                     image.alias("source")).where(present("source", "").isNotNull())
    return list_positions(kept, keys, ["ord"], **{"sized_by": df, **options}).select(
        *keys, (F.col("idx") + 1).alias("page_num"), "created_sec", "source")


def page_numbers(df: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Fill missing page numbers with the position in the slide list."""
    numbered = list_positions(df, keys or ["lecture_id"], ["ord"], **options)
    return numbered.withColumn("page_num", F.coalesce(present("page_num"), F.col("idx") + 1)).drop("idx")


def dedup_slides(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first slide of every fingerprint; slides without an image have none.

    The minimum combines before the shuffle, so any number of copies is cheap.
    """
    keys = keys or ["lecture_id"]
    rest = [c for c in df.columns if c not in (*keys, "dhash")]
    first = (df.where(present("dhash", "").isNotNull())
             .groupBy(*keys, "dhash").agg(F.min_by(F.struct(*rest), "ord").alias("_first")))
    return first.select(*keys, "dhash", "_first.*")


def dhash_bits(grid: Column) -> Column:
    """Fingerprint of a 9 by 8 brightness grid, row after row, as 16 hex digits.

    Bit by bit from the top left: set where the right neighbour is brighter.
    """
    # Written out bit by bit, so that it compiles to plain comparisons.
    value = F.lit(0).cast("bigint")
    for row in range(8):
        for column in range(8):
            at = row * 9 + column
            weight = 1 << (63 - row * 8 - column)
            signed = weight - (1 << 64) if weight >> 63 else weight
            value = value.bitwiseOR(F.when(F.get(grid, F.lit(at + 1)) > F.get(grid, F.lit(at)), signed).otherwise(0))
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def page_text(lines: DataFrame, keys: list[str], pages: DataFrame | None = None, **options) -> DataFrame:
    """Recognised lines to page text: trimmed, blanks dropped, joined by line breaks.

    Parts as in ``document_parts``. A page without lines has an empty part 0; ``pages``
    may list the pages where that is cheaper than taking them from the lines.
    """
    kept = lines.select(*keys, "ord", strip(F.coalesce("line", F.lit(""))).alias("line")).where("line <> ''")
    numbered = list_positions(kept, keys, ["ord"], **{"sized_by": lines, **options})
    pieces = numbered.select(*keys, F.col("idx").alias("ord"),
                             F.concat(F.when(F.col("idx") > 0, "\n").otherwise(""), "line").alias("piece"))
    known = lines if pages is None else pages
    heads = known.select(*keys).distinct().select(
        *keys, F.lit(-1).cast("bigint").alias("ord"), F.lit("").alias("piece"))
    return document_parts(pieces.unionByName(heads), keys, "ord", "piece", LINES_PER_PART)


def assign_windows(segments: DataFrame, keys: list[str] | None = None, size: int = SEGMENTS_PER_WINDOW) -> DataFrame:
    """Windows of ``size`` consecutive segments with their first start and last end.

    Takes ``ord`` as the dense list position (see ``normalise_segments``).
    """
    keys = keys or ["lecture_id"]
    start = first_present("start_ms")
    windows = (
        segments.withColumn("window_id", window_of("ord", size))
        .groupBy(*keys, "window_id")
        .agg(F.count(F.lit(1)).alias("segments"), F.min_by(start, "ord").cast("bigint").alias("lower_ms"),
             F.max_by(present("end_ms"), "ord").cast("bigint").alias("_last"))
    )
    return windows.select(*keys, "window_id", "segments", "lower_ms",
                          F.coalesce("_last", "lower_ms").alias("upper_ms"))


def slides_to_windows(slides: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Slides in each transcript window, both ends included.

    A slide on a shared boundary joins two windows; a slide in a gap joins none.
    """
    keys = keys or ["lecture_id"]
    timed = slides.withColumn("at_ms", first_present("created_sec").cast("bigint") * 1000)
    return join_points_to_intervals(timed, windows, keys, "at_ms", "lower_ms", "upper_ms")


def slides_untimed_windows(lectures: DataFrame, slides: DataFrame, keys: list[str] | None = None,
                           size: int = SLIDES_PER_WINDOW, **options) -> DataFrame:
    """Without a transcript: ``size`` slides to a window, at least one window each.

    Slides of the lectures, and the lectures without slides with one empty window: a
    left join would send all slides of a lecture to one task.
    """
    keys = keys or ["lecture_id"]
    known = lectures.select(*keys).distinct()
    numbered = list_positions(slides, keys, ["ord"], **options).withColumn("window_id", window_of("idx", size))
    empty = known.join(slides.select(*keys).distinct(), keys, "left_anti").withColumn(
        "window_id", F.lit(0).cast("bigint"))
    return numbered.join(known, keys, "left_semi").unionByName(empty, allowMissingColumns=True)


def merge_request(titles: DataFrame, notes: DataFrame, keys: list[str] | None = None,
                  per_part: int = 1000, **options) -> DataFrame:
    """One merge request per lecture: its title and its window notes in order.

    ``notes`` has ``window_id`` and the note as JSON text; the request comes in parts.
    """
    keys = keys or ["lecture_id"]
    numbered = list_positions(notes, keys, ["window_id"], **options)
    pieces = numbered.select(*keys, F.col("idx").alias("ord"),
                             F.concat(F.when(F.col("idx") > 0, ",").otherwise(""), "note").alias("piece"))
    title = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title")))
    head = titles.withColumn("_t", title).select(
        *keys, F.lit(-1).cast("bigint").alias("ord"),
        F.concat(F.expr("left(_t, length(_t) - 1)"), F.lit(',"parts":[')).alias("piece"))
    counts = notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    foot = titles.select(*keys).join(counts, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("ord"), F.lit("]}").alias("piece"))
    return document_parts(pieces.unionByName(head).unionByName(foot), keys, "ord", "piece", per_part, "request")


def pack_transcript(segments: DataFrame, keys: list[str] | None = None, size: int = SEGMENTS_PER_WINDOW) -> DataFrame:
    """The segments of each summary window as one JSON array."""
    keys = keys or ["lecture_id"]
    item = F.struct("ord", F.struct("start_ms", "end_ms", "text").alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"])
    return (
        segments.withColumn("window_id", window_of("ord", size))
        .groupBy(*keys, "window_id")
        .agg(F.count(F.lit(1)).alias("items"), F.to_json(ordered).alias("transcript"))
    )


def window_requests(packed: DataFrame, members: DataFrame, keys: list[str] | None = None,
                    per_part: int = 1000, **options) -> DataFrame:
    """The summary request of each window: its transcript and its slides in order.

    ``packed`` comes from ``pack_transcript``; ``members`` has the slides of each window
    with ``page_num``, ``created_sec`` and ``text``. A window with very many slides takes
    several parts.
    """
    keys = [*(keys or ["lecture_id"]), "window_id"]
    numbered = list_positions(members, keys, ["ord"], **options)
    page = F.to_json(F.struct("page_num", "created_sec", "text"))
    pieces = numbered.select(*keys, F.col("idx").alias("ord"),
                             F.concat(F.when(F.col("idx") > 0, ",").otherwise(""), page).alias("piece"))
    head = packed.select(*keys, F.lit(-1).cast("bigint").alias("ord"),
                         F.concat(F.lit('{"transcript":'), "transcript", F.lit(',"ppt_pages":[')).alias("piece"))
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    foot = packed.select(*keys).join(counts, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("ord"), F.lit("]}").alias("piece"))
    return document_parts(pieces.unionByName(head).unionByName(foot), keys, "ord", "piece", per_part, "request")
