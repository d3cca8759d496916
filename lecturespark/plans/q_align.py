"""Recogniser alignment, requests, corrections and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align
from .q_segments import duck_normalised
from . import inputs  # noqa: F401
from .registry import define_input, query

# Responses of a model: fenced or plain, cut short, of a wrong shape, with odd items.
define_input("responses_json", """
SELECT CAST(floor(conv_id / 25) AS BIGINT) AS lecture_id, conv_id * 10 + turn AS window_id,
       CASE turn % 8
         WHEN 0 THEN concat('[{"index":', CAST(turn AS STRING), ',"text":"one"},{"index":7},{"text":"no index"},5]')
         WHEN 1 THEN concat('```json', {nl}, '[{"index":', CAST(conv_id AS STRING), ',"text":"', CAST(length(text) AS STRING), ' chars"}]', {nl}, '```')
         WHEN 2 THEN '{"index":1,"text":"lone object"}'
         WHEN 3 THEN concat('  ```', {nl}, '[]', {nl}, '```  ')
         WHEN 4 THEN '[{"index":1,"text":"cut'
         WHEN 5 THEN '[{"index":1,"text":"a"}] thanks'
         WHEN 6 THEN '```[]```'
         ELSE '[{"index":3,"text":null}]' END AS response
FROM {conversations}""")

define_input("summary_json", """
SELECT doc_id,
       CASE doc_id % 6
         WHEN 0 THEN concat('{"markdown":" note ', CAST(doc_id AS STRING), ' ","chapters":[{"start_ms":0},3]}')
         WHEN 1 THEN concat('```json', {nl}, '{"markdown":"', source, '","chapters":[]}', {nl}, '```')
         WHEN 2 THEN '{"markdown":5,"chapters":[]}'
         WHEN 3 THEN '{"markdown":"x","chapters":{}}'
         WHEN 4 THEN '["markdown"]'
         ELSE '{"markdown":"x"' END AS response
FROM {documents}""")

PAIRS = """a AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) - 1 AS idx FROM $segments_a),
b AS (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) - 1 AS idx FROM $segments_b),
pairs AS (
  SELECT coalesce(a.lecture_id, b.lecture_id) AS lecture_id, coalesce(a.idx, b.idx) AS idx,
         coalesce(nullif(a.start_ms, 0), nullif(b.start_ms, 0), 0) AS start_ms,
         coalesce(nullif(a.end_ms, 0), nullif(b.end_ms, 0), 0) AS end_ms,
         coalesce(a.text, '') AS text_a, coalesce(b.text, '') AS text_b
  FROM a FULL JOIN b ON a.lecture_id = b.lecture_id AND a.idx = b.idx)"""

CORRECTED = PAIRS + """,
windows AS (SELECT *, CASE WHEN idx % 31 = 5 THEN idx // 20 + 1 ELSE idx // 20 END AS window_id FROM $corrections),
last AS (SELECT lecture_id, window_id, idx, arg_max(text, ord) AS fixed FROM windows GROUP BY ALL),
merged AS (
  SELECT p.lecture_id, p.idx AS ord, p.start_ms, p.end_ms,
         coalesce(nullif(fixed, ''), nullif(text_b, ''), text_a) AS text
  FROM pairs p LEFT JOIN last l ON l.lecture_id = p.lecture_id AND l.idx = p.idx AND l.window_id = p.idx // 20)"""


def corrections(load):
    window = F.floor(F.col("idx") / 20).cast("bigint")
    return load("corrections").withColumn("window_id", F.when(F.col("idx") % 31 == 5, window + 1).otherwise(window))


def pairs(load):
    return align.align_recognisers(load("segments_a"), load("segments_b"))


def pair_keys(load):
    """At least as many rows per lecture as there are pairs, from the keys alone."""
    return load("segments_a").select("lecture_id").unionAll(load("segments_b").select("lecture_id"))


@query("align_recognisers", f"WITH {PAIRS} SELECT * FROM pairs")
def _(load):
    return pairs(load)


@query("pack_requests", f"""
WITH {PAIRS}
SELECT lecture_id, idx // 20 AS window_id, count(*) AS items,
       '[' || string_agg(to_json({{'index': idx, 'start_ms': start_ms, 'end_ms': end_ms,
                                  'sensevoice': text_a, 'firered': text_b}})::VARCHAR, ',' ORDER BY idx) || ']' AS request
FROM pairs GROUP BY ALL""")
def _(load):
    return align.pack_requests(pairs(load))


@query("apply_corrections", f"""
WITH RECURSIVE {CORRECTED}, {duck_normalised('merged')}
SELECT lecture_id, n - 1 AS ord, start_ms, end_ms, text FROM norm""")
def _(load):
    return align.corrected_segments(pairs(load), corrections(load), sized_by=pair_keys(load))


@query("select_mode", f"""
WITH RECURSIVE {CORRECTED},
modes AS (SELECT DISTINCT lecture_id, lecture_id % 4 AS m FROM $segments_a),
chosen AS (
  SELECT lecture_id, ord, start_ms, end_ms, text FROM $segments_a JOIN modes USING (lecture_id) WHERE m = 0
  UNION ALL
  SELECT lecture_id, ord, start_ms, end_ms, text FROM $segments_b JOIN modes USING (lecture_id) WHERE m = 1
  UNION ALL
  SELECT lecture_id, ord, start_ms, end_ms, text FROM merged JOIN modes USING (lecture_id) WHERE m = 2),
{duck_normalised('chosen')}
SELECT lecture_id, n - 1 AS ord, start_ms, end_ms, text FROM norm""")
def _(load):
    modes = load("segments_a").select("lecture_id").distinct().withColumn(
        "mode", F.expr("CASE lecture_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'no-proofread' WHEN 2 THEN '' ELSE 'odd' END"))
    standard = [align.of_mode(load(name), modes, "standard") for name in ("segments_a", "segments_b")]
    corrected = align.apply_corrections(align.align_recognisers(*standard), corrections(load))
    return align.select_mode(modes, load("segments_a"), load("segments_b"), corrected, sized_by=pair_keys(load))


# What each of the made responses means, without any JSON reading.
@query("parse_model_json", """
WITH r AS (SELECT CAST(floor(conv_id / 25) AS BIGINT) AS lecture_id, conv_id * 10 + turn AS window_id,
                  conv_id, turn, turn % 8 AS k, length(text) AS chars FROM conversations)
SELECT lecture_id, window_id, 'ok' AS status, CAST(0 AS BIGINT) AS ord, turn AS idx, 'one' AS text FROM r WHERE k = 0
UNION ALL SELECT lecture_id, window_id, 'ok', 1, 7, '' FROM r WHERE k = 0
UNION ALL SELECT lecture_id, window_id, 'ok', 0, conv_id, CAST(chars AS VARCHAR) || ' chars' FROM r WHERE k = 1
UNION ALL SELECT lecture_id, window_id, 'not_array', NULL, NULL, '' FROM r WHERE k = 2
UNION ALL SELECT lecture_id, window_id, 'not_json', NULL, NULL, '' FROM r WHERE k IN (4, 5, 6)
UNION ALL SELECT lecture_id, window_id, 'ok', 0, 3, '' FROM r WHERE k = 7""")
def _(load):
    return align.parse_corrections(load("responses_json"))


@query("parse_summary_json", """
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'not_json' WHEN doc_id % 6 < 2 THEN 'ok' ELSE 'bad_shape' END AS status,
       CASE doc_id % 6 WHEN 0 THEN 'note ' || CAST(doc_id AS VARCHAR) WHEN 1 THEN source END AS markdown,
       CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS BIGINT) AS chapters
FROM documents""")
def _(load):
    return align.parse_summaries(load("summary_json"), ["doc_id"]).select(
        "doc_id", "status", "markdown", F.size("chapters").cast("bigint").alias("chapters"))
