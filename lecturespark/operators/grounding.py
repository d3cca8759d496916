"""Checking chapters and citations against what they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model_json import strip
from ..functions.text import first_present, present

# Fixed value: the answer given when no evidence supports one.
REFUSAL = "资料不足，无法根据当前课程资料回答。"


def anchor_union(segments: DataFrame, slides: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Times a chapter may start at: segment starts and slide times, each once."""
    keys = keys or ["lecture_id"]
    starts = segments.select(*keys, first_present("start_ms").cast("bigint").alias("start_ms"))
    times = slides.select(*keys, (first_present("created_sec").cast("bigint") * 1000).alias("start_ms"))
    return starts.unionByName(times).distinct()


def ground_chapters(chapters: DataFrame, segments: DataFrame, slides: DataFrame,
                    keys: list[str] | None = None) -> DataFrame:
    """Chapters that start at a known time; title and summary trimmed."""
    keys = keys or ["lecture_id"]
    timed = chapters.withColumn("start_ms", first_present("start_ms").cast("bigint"))
    kept = timed.join(anchor_union(segments, slides, keys), [*keys, "start_ms"], "left_semi")
    return kept.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("title", "summary")})


def usable_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.where(present("citation_id", "").isNotNull() & present("text", "").isNotNull())


def ground_citations(answers: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Keep all citations that name usable evidence of the query, in order, repeats included.

    ``limit`` keeps the first few only.

    ``answers`` has one row per ``answer_id`` with ``query_id``, ``answer``,
    ``grounded`` and ``citations``. An answer that claims no grounding, or keeps no
    citation, becomes the fixed refusal. Only an answer's own citations are ever
    grouped; the evidence of a query is joined, not collected.
    """
    allowed = usable_evidence(evidence).select("query_id", F.col("citation_id").alias("cited")).distinct()
    named = answers.select("answer_id", "query_id", F.posexplode("citations").alias("pos", "cited"))
    kept = (
        named.join(allowed, ["query_id", "cited"], "left_semi")
        .groupBy("answer_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "cited"))).alias("_kept"))
    )
    joined = answers.join(kept, "answer_id", "left")
    grounded = F.coalesce(F.col("grounded"), F.lit(False)) & F.col("_kept").isNotNull()
    cited = F.transform("_kept", lambda x: x["cited"])
    if limit is not None:
        cited = F.slice(cited, 1, limit)
    return joined.select(
        "answer_id", "query_id",
        F.when(grounded, strip("answer")).otherwise(REFUSAL).alias("answer"),
        F.when(grounded, cited).otherwise(F.array().cast("array<string>")).alias("citations"),
        grounded.alias("grounded"),
    )
