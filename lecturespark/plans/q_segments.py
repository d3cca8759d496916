"""Segments, captions, grids and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_asr_text, clock
from ..operators import captions, segments
from . import inputs  # noqa: F401
from .registry import query

# The white space the cleaning step collapses, as an RE2 class for the oracle.
DUCK_BLANKS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
               r"\x{202F}\x{205F}\x{3000}]+")


def duck_clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{DUCK_BLANKS}', ' ', 'g'))"


def duck_clock(column: str, separator: str) -> str:
    value = f"greatest({column}, 0)"
    return (f"(CASE WHEN {value} < 36000000 THEN '0' ELSE '' END || CAST({value} // 3600000 AS VARCHAR) || ':' || "
            f"lpad(CAST({value} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST({value} // 1000 % 60 AS VARCHAR), 2, '0') || '{separator}' || "
            f"lpad(CAST({value} % 1000 AS VARCHAR), 3, '0'))")


# The reference's loop itself, row by row, as a recursive query.
def duck_normalised(source: str = "$segments_a", key: str = "lecture_id") -> str:
    return f"""clean AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(start_ms, 0), ord) AS n,
         coalesce(start_ms, 0) AS s, nullif(end_ms, 0) AS e, t AS text
  FROM (SELECT *, {duck_clean('text')} AS t FROM {source}) WHERE t <> ''),
norm AS (
  SELECT {key}, n, greatest(0, s) AS start_ms,
         greatest(greatest(0, s) + 200, coalesce(e, greatest(0, s) + 1000)) AS end_ms, text
  FROM clean WHERE n = 1
  UNION ALL
  SELECT c.{key}, c.n, greatest(p.end_ms, c.s),
         greatest(greatest(p.end_ms, c.s) + 200, coalesce(c.e, greatest(p.end_ms, c.s) + 1000)), c.text
  FROM norm p JOIN clean c ON c.{key} = p.{key} AND c.n = p.n + 1)"""


@query("clean_text", f"""
SELECT lecture_id, ord, {duck_clean('text')} AS text FROM $segments_a
WHERE {duck_clean('text')} <> ''""")
def _(load):
    return segments.clean_segments(load("segments_a")).select("lecture_id", "ord", "text")


@query("clean_asr_text", f"""
SELECT doc_id, {duck_clean("replace(text, '.', '')")} AS text
FROM documents WHERE {duck_clean("replace(text, '.', '')")} <> ''""")
def _(load):
    marked = F.replace(F.replace("text", F.lit("."), F.lit("<sil>")), F.lit(" "), F.lit(" <sil>"))
    return segments.clean_segments(load("documents").select("doc_id", marked.alias("text")), clean_asr_text)


@query("timestamp_render", f"""
SELECT event_id, {duck_clock('(event_id - 5) * 7654321', ',')} AS srt,
       {duck_clock('(event_id - 5) * 7654321', '.')} AS vtt FROM events""")
def _(load):
    ms = (F.col("event_id") - 5) * 7654321
    return load("events").select("event_id", clock(ms, ",").alias("srt"), clock(ms, ".").alias("vtt"))


@query("normalise_segments", f"""
WITH RECURSIVE {duck_normalised()}
SELECT lecture_id, n - 1 AS ord, start_ms, end_ms, text FROM norm""")
def _(load):
    return segments.normalise_segments(load("segments_a"))


@query("captions_srt", f"""
WITH RECURSIVE {duck_normalised()},
cues AS (SELECT lecture_id, n, CAST(n AS VARCHAR) || chr(10) || {duck_clock('start_ms', ',')} || ' --> '
                || {duck_clock('end_ms', ',')} || chr(10) || text AS cue FROM norm),
docs AS (SELECT lecture_id, (n - 1) // 50 AS part, min(n) AS first, string_agg(cue, chr(10) || chr(10) ORDER BY n) AS body
         FROM cues GROUP BY ALL)
SELECT l.lecture_id, coalesce(part, 0) AS part,
       CASE WHEN first IS NULL THEN '' WHEN part > 0 THEN chr(10) || body || chr(10) ELSE body || chr(10) END AS text
FROM (SELECT DISTINCT lecture_id FROM $segments_a) l LEFT JOIN docs USING (lecture_id)""")
def _(load):
    return captions.captions_srt(load("segments_a"), per_part=50)


@query("captions_vtt", f"""
WITH RECURSIVE {duck_normalised()},
cues AS (SELECT lecture_id, n, {duck_clock('start_ms', '.')} || ' --> '
                || {duck_clock('end_ms', '.')} || chr(10) || text AS cue FROM norm),
docs AS (SELECT lecture_id, (n - 1) // 50 AS part, string_agg(chr(10) || cue || chr(10), '' ORDER BY n) AS body FROM cues GROUP BY ALL)
SELECT lecture_id, part, CASE WHEN part = 0 THEN 'WEBVTT' || chr(10) ELSE '' END || coalesce(body, '') AS text
FROM (SELECT lecture_id, part FROM docs UNION SELECT lecture_id, 0 FROM $segments_a) LEFT JOIN docs USING (lecture_id, part)""")
def _(load):
    return captions.captions_vtt(load("segments_a"), per_part=50)


@query("smoke_stats", """
SELECT 'a' AS recogniser, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters FROM $segments_a
UNION ALL
SELECT 'b', count(*), CAST(sum(length(text)) AS BIGINT) FROM $segments_b""")
def _(load):
    both = load("segments_a").select(F.lit("a").alias("recogniser"), "text").unionByName(
        load("segments_b").select(F.lit("b").alias("recogniser"), "text"))
    return segments.recogniser_stats(both, ["recogniser"])
