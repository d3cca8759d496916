"""Aligning two recognisers, packing requests and merging corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model_json import field, is_array, is_string, json_value, shape_of, strip, truthy, unfence
from ..functions.text import first_present, present
from .scan import list_positions
from .segments import normalise_segments

PAIRS_PER_REQUEST = 20

# Field names of a proofreading request.
REQUEST_FIELDS = ("index", "start_ms", "end_ms", "sensevoice", "firered")
# Which recogniser result each subtitle mode uses.
MODES = ("fast", "no-proofread", "standard")


def align_recognisers(a: DataFrame, b: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Pair two segment lists by list position; the first list's times win if set."""
    keys = keys or ["lecture_id"]

    def side(df: DataFrame, name: str) -> DataFrame:
        numbered = list_positions(df, keys, ["ord"], **options)
        return numbered.select(*keys, "idx", F.col("start_ms").alias(f"start_{name}"),
                               F.col("end_ms").alias(f"end_{name}"), F.col("text").alias(f"text_{name}"))

    pairs = side(a, "a").join(side(b, "b"), [*keys, "idx"], "full")
    return pairs.select(
        *keys, "idx",
        first_present("start_a", "start_b").cast("bigint").alias("start_ms"),
        first_present("end_a", "end_b").cast("bigint").alias("end_ms"),
        F.coalesce("text_a", F.lit("")).alias("text_a"),
        F.coalesce("text_b", F.lit("")).alias("text_b"),
    )


def window_of(idx: str, size: int):
    return F.floor(F.col(idx) / size).cast("bigint")


def pack_requests(pairs: DataFrame, keys: list[str] | None = None, size: int = PAIRS_PER_REQUEST) -> DataFrame:
    """One JSON request for every ``size`` pairs of a lecture."""
    keys = keys or ["lecture_id"]
    item = F.struct(*[F.col(c).alias(n) for c, n in
                      zip(("idx", "start_ms", "end_ms", "text_a", "text_b"), REQUEST_FIELDS)])
    return (
        pairs.withColumn("window_id", window_of("idx", size))
        .groupBy(*keys, "window_id")
        .agg(F.count(F.lit(1)).alias("items"), F.to_json(F.array_sort(F.collect_list(item))).alias("request"))
    )


def parse_corrections(responses: DataFrame, keys: list[str] | None = None, column: str = "response") -> DataFrame:
    """Items of correction responses; ``status`` tells why a response has none.

    A response must be a JSON array. Items that are no object or have no index
    are left out. A rejected response stays as one row with its reason.
    """
    keys = keys or ["lecture_id", "window_id"]
    value = json_value(unfence(column))
    parsed = responses.select(*keys, value.alias("_v")).withColumn("_shape", shape_of(F.col("_v")))
    status = (F.when(F.col("_shape") == "invalid", "not_json")
              .when(F.col("_shape") != "array", "not_array").otherwise("ok"))
    items = parsed.select(*keys, status.alias("status"), F.posexplode_outer(
        F.when(F.col("_shape") == "array", F.try_variant_get("_v", "$", "array<variant>"))).alias("ord", "_item"))
    items = items.select(*keys, "status", F.col("ord").cast("bigint").alias("ord"),
                         field(F.col("_item"), "index", "bigint").alias("idx"),
                         F.coalesce(field(F.col("_item"), "text", "string"), F.lit("")).alias("text"))
    return items.where((F.col("status") != "ok") | F.col("idx").isNotNull())


def _shaped(responses: DataFrame, keys: list[str], column: str, text: str, items: str) -> DataFrame:
    """Responses that must be an object with one string field and one array field."""
    parsed = responses.select(*keys, json_value(unfence(column)).alias("_v"))
    value = F.col("_v")
    fits = (shape_of(value) == "object") & is_string(value, text) & is_array(value, items)
    return parsed.withColumn(
        "status", F.when(value.isNull(), "not_json").when(fits, "ok").otherwise("bad_shape")
    ).withColumns({
        text: F.when(fits, strip(field(value, text, "string"))),
        items: F.when(fits, field(value, items, "array<variant>")),
    })


def parse_summaries(responses: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """Summary responses: ``markdown`` and the ``chapters`` as an array of values."""
    return _shaped(responses, keys, column, "markdown", "chapters").drop("_v")


def parse_answers(responses: DataFrame, keys: list[str], column: str = "response") -> DataFrame:
    """Answer responses: ``answer``, ``citations`` as strings and the claimed ``grounded``."""
    shaped = _shaped(responses, keys, column, "answer", "citations")
    return shaped.select(
        *keys, "status", "answer",
        F.transform("citations", lambda c: F.try_variant_get(c, "$", "string")).alias("citations"),
        truthy(field(F.col("_v"), "grounded", "variant")).alias("grounded"))


def chapter_rows(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters of parsed summaries as rows; items that are no object are left out."""
    items = summaries.select(*keys, F.posexplode("chapters").alias("ord", "_c"))
    is_object = F.schema_of_variant("_c").startswith("OBJECT")
    return items.where(is_object).select(
        *keys, "ord", *[field(F.col("_c"), n, k).alias(n)
                        for n, k in (("title", "string"), ("start_ms", "bigint"), ("summary", "string"))])


def apply_corrections(pairs: DataFrame, corrections: DataFrame, keys: list[str] | None = None,
                      size: int = PAIRS_PER_REQUEST) -> DataFrame:
    """Corrected text, else the second recogniser's, else the first's (not yet normalised).

    The last correction of an index wins; an index outside its window has no pair.
    """
    keys = keys or ["lecture_id"]
    on = [*keys, "window_id", "idx"]
    last = corrections.groupBy(*on).agg(F.max_by("text", "ord").alias("fixed"))
    merged = pairs.withColumn("window_id", window_of("idx", size)).join(last, on, "left")
    text = F.coalesce(present("fixed", ""), present("text_b", ""), F.col("text_a"))
    return merged.select(*keys, F.col("idx").alias("ord"), "start_ms", "end_ms", text.alias("text"))


def corrected_segments(pairs: DataFrame, corrections: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    return normalise_segments(apply_corrections(pairs, corrections, keys), keys, **options)


def select_mode(modes: DataFrame, a: DataFrame, b: DataFrame, corrected: DataFrame,
                keys: list[str] | None = None, **options) -> DataFrame:
    """Final segments by the lecture's subtitle mode (missing means standard)."""
    keys = keys or ["lecture_id"]
    columns = [*keys, "ord", "start_ms", "end_ms", "text"]
    chosen = [of_mode(df, modes, mode, keys).select(*columns) for mode, df in zip(MODES, (a, b, corrected))]
    return normalise_segments(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]), keys, **options)


def of_mode(rows: DataFrame, modes: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of lectures with a mode; apply it to the inputs of a costly branch, before its joins."""
    keys = keys or ["lecture_id"]
    wanted = modes.where(F.coalesce(present("mode", ""), F.lit("standard")) == mode).select(*keys)
    return rows.join(wanted, keys, "left_semi")
