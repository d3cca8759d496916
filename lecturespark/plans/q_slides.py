"""Slides, windows and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, grounding, segments, slides
from .q_segments import duck_normalised
from . import inputs  # noqa: F401
from .registry import define_input, query

define_input("slide_content", """
SELECT page_id % 8 AS lecture_id, page_id AS ord,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE (page_id * 7) % 700 END AS created_sec,
       CASE page_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN '{"pptimgurl":""}' WHEN 3 THEN '{}'
            ELSE concat('{"pptimgurl":"', url, '"}') END AS content
FROM {pages}""")

define_input("slides_only", """
SELECT page_id % 8 AS lecture_id, page_id AS ord FROM {pages}""")

define_input("page_lines", """
SELECT doc_id, text, CAST(floor(n_chars) AS BIGINT) AS n_chars FROM {documents}""")

define_input("chapters", """
SELECT page_id % 8 AS lecture_id, page_id AS ord, concat('  T', CAST(page_id AS STRING), ' ') AS title,
       CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 < 3 THEN ((page_id * 7) % 700) * 1000
            ELSE (page_id % 25) * 24000 + 3000 END AS start_ms,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE ' s ' END AS summary
FROM {pages}""")

SLIDE_TIMES = "(SELECT lecture_id, ord, created_sec FROM $slides)"
WINDOWS = """windows AS (
  SELECT lecture_id, (n - 1) // 120 AS window_id, count(*) AS segments, arg_min(start_ms, n) AS lower_ms,
         arg_max(end_ms, n) AS upper_ms FROM norm GROUP BY ALL)"""


def windows(load):
    return slides.assign_windows(segments.normalise_segments(load("segments_a")))


@query("slide_rows", """
SELECT lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) AS page_num,
       coalesce(created_sec, 0) AS created_sec, json_extract_string(content, '$.pptimgurl') AS source
FROM $slide_content
WHERE coalesce(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.pptimgurl') END, '') <> ''""")
def _(load):
    return slides.slide_rows(load("slide_content"))


@query("page_number", """
SELECT lecture_id, ord, created_sec, dhash,
       coalesce(nullif(page_num, 0), row_number() OVER (PARTITION BY lecture_id ORDER BY ord)) AS page_num
FROM $slides""")
def _(load):
    return slides.page_numbers(load("slides"))


@query("dedup_slides", """
SELECT lecture_id, ord, page_num, created_sec, dhash FROM (
  SELECT *, row_number() OVER (PARTITION BY lecture_id, dhash ORDER BY ord) AS r FROM $slides WHERE dhash <> '')
WHERE r = 1""")
def _(load):
    return slides.dedup_slides(load("slides"))


def _duck_bit(k: str) -> str:
    return f"CASE WHEN g[{k} + {k} // 8 + 2] > g[{k} + {k} // 8 + 1] THEN 1 ELSE 0 END"


@query("dhash_bits", f"""
SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', CAST(1
    + 8 * ({_duck_bit('(4 * k)')}) + 4 * ({_duck_bit('(4 * k + 1)')})
    + 2 * ({_duck_bit('(4 * k + 2)')}) + ({_duck_bit('(4 * k + 3)')}) AS BIGINT), 1)), '') AS dhash
FROM (SELECT vec_id, embedding || embedding[1:8] AS g FROM embeddings)""")
def _(load):
    grid = F.concat("embedding", F.slice("embedding", 1, 8))
    return load("embeddings").select("vec_id", slides.dhash_bits(grid).alias("dhash"))


@query("page_text", """
SELECT d.doc_id, CAST(0 AS BIGINT) AS part, coalesce(t.text, '') AS text FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(s, chr(10) ORDER BY n) AS text FROM (
    SELECT doc_id, n, regexp_replace(line, '^[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '', 'g') AS s
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents))
  WHERE s <> '' GROUP BY doc_id) t USING (doc_id)""")
def _(load):
    lines = load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    # The lines of a page come from one row here, which bounds them without a count.
    return slides.page_text(lines, ["doc_id"], load("documents"), blocked=False)


@query("assign_windows", f"""
WITH RECURSIVE {duck_normalised()}, {WINDOWS} SELECT * FROM windows""")
def _(load):
    return windows(load)


@query("summary_requests", f"""
WITH RECURSIVE {duck_normalised()}
SELECT lecture_id, (n - 1) // 120 AS window_id, count(*) AS items,
       '[' || string_agg(to_json({{'start_ms': start_ms, 'end_ms': end_ms, 'text': text}})::VARCHAR, ',' ORDER BY n)
       || ']' AS transcript
FROM norm GROUP BY ALL""")
def _(load):
    return slides.pack_transcript(segments.normalise_segments(load("segments_a")))


@query("slides_to_windows", f"""
WITH RECURSIVE {duck_normalised()}, {WINDOWS}
SELECT w.lecture_id, w.window_id, s.ord, s.created_sec FROM windows w
JOIN {SLIDE_TIMES} s ON s.lecture_id = w.lecture_id AND s.created_sec * 1000 BETWEEN w.lower_ms AND w.upper_ms""")
def _(load):
    return slides.slides_to_windows(load("slides"), windows(load)).select(
        "lecture_id", "window_id", "ord", "created_sec")


@query("slides_untimed_windows", """
SELECT l.lecture_id, coalesce(s.n // 20, 0) AS window_id, s.ord
FROM (SELECT DISTINCT page_id % 12 AS lecture_id FROM pages) l
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) - 1 AS n FROM $slides_only) s
  USING (lecture_id)""")
def _(load):
    lectures = load("pages").select((F.col("page_id") % 12).alias("lecture_id"))
    return slides.slides_untimed_windows(lectures, load("slides_only")).select("lecture_id", "window_id", "ord")


@query("merge_parts", f"""
WITH RECURSIVE {duck_normalised()}, {WINDOWS},
lectures AS (SELECT DISTINCT page_id % 8 AS lecture_id FROM pages UNION SELECT DISTINCT lecture_id FROM $segments_a)
SELECT l.lecture_id, CAST(0 AS BIGINT) AS part,
       '{{"title":"L' || CAST(l.lecture_id AS VARCHAR) || '","parts":[' || coalesce(body, '') || ']}}' AS request
FROM lectures l LEFT JOIN (
  SELECT lecture_id, string_agg(to_json({{'markdown': 'w' || CAST(window_id AS VARCHAR), 'start_ms': lower_ms}})::VARCHAR,
                                ',' ORDER BY window_id) AS body
  FROM windows GROUP BY lecture_id) USING (lecture_id)""")
def _(load):
    notes = windows(load).select("lecture_id", "window_id", F.to_json(F.struct(
        F.concat(F.lit("w"), F.col("window_id").cast("string")).alias("markdown"),
        F.col("lower_ms").alias("start_ms"))).alias("note"))
    lectures = load("pages").select((F.col("page_id") % 8).alias("lecture_id")).union(
        load("segments_a").select("lecture_id")).distinct()
    titles = lectures.withColumn("title", F.concat(F.lit("L"), F.col("lecture_id").cast("string")))
    return slides.merge_request(titles, notes)


ANCHORS = """anchors AS (
  SELECT lecture_id, coalesce(start_ms, 0) AS start_ms FROM $segments_b
  UNION SELECT lecture_id, created_sec * 1000 FROM $slides)"""


@query("anchor_union", f"WITH {ANCHORS} SELECT * FROM anchors")
def _(load):
    return grounding.anchor_union(load("segments_b"), load("slides"))


@query("ground_chapters", f"""
WITH {ANCHORS}
SELECT lecture_id, ord, trim(title) AS title, coalesce(start_ms, 0) AS start_ms, trim(coalesce(summary, '')) AS summary
FROM $chapters c
WHERE EXISTS (SELECT 1 FROM anchors a WHERE a.lecture_id = c.lecture_id AND a.start_ms = coalesce(c.start_ms, 0))""")
def _(load):
    return grounding.ground_chapters(load("chapters"), load("segments_b"), load("slides"))


# An answer cites documents of its own query, of others, twice, and unknown ones.
define_input("answers", """
SELECT doc_id AS answer_id, doc_id % 50 AS query_id, concat('  answer ', CAST(doc_id AS STRING)) AS answer,
       doc_id % 4 <> 1 AS claims,
       concat('"', CAST(doc_id AS STRING), '","', CAST(doc_id + 1 AS STRING), '",', CAST(doc_id % 50 AS STRING), ',"',
              CAST(doc_id % 50 + 50 AS STRING), '","x","', CAST(doc_id % 50 + 100 AS STRING), '","',
              CAST(doc_id % 50 + 150 AS STRING), '","', CAST(doc_id % 50 + 50 AS STRING), '","',
              CAST(doc_id % 50 + 100 AS STRING), '","', CAST(doc_id % 50 + 150 AS STRING), '","', CAST(doc_id AS STRING), '","',
              CAST(doc_id % 50 + 50 AS STRING), '"') AS cites
FROM {documents}""")


@query("ground_citations", f"""
WITH cited AS (
  SELECT answer_id, query_id, unnest(string_split(replace(cites, '"', ''), ',')) AS cid,
         unnest(range(0, len(string_split(cites, ',')))) AS pos FROM $answers),
kept AS (
  SELECT answer_id, string_agg(cid, ',' ORDER BY pos) AS citations FROM (
    SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS r FROM cited c
    WHERE EXISTS (SELECT 1 FROM $evidence e WHERE e.query_id = c.query_id AND e.citation_id = c.cid AND e.text <> ''))
  GROUP BY answer_id)
SELECT a.answer_id, a.query_id, claims AND citations IS NOT NULL AS grounded,
       CASE WHEN claims AND citations IS NOT NULL THEN trim(answer) ELSE '{grounding.REFUSAL}' END AS answer,
       CASE WHEN claims AND citations IS NOT NULL THEN citations ELSE '' END AS citations
FROM $answers a LEFT JOIN kept USING (answer_id)""")
def _(load):
    text = F.concat(F.lit('{"answer":"'), "answer", F.lit('","grounded":'), F.col("claims").cast("string"),
                    F.lit(',"citations":['), "cites", F.lit("]}"))
    answers = align.parse_answers(load("answers").withColumn("response", text), ["answer_id", "query_id"])
    grounded = grounding.ground_citations(answers, load("evidence"))
    return grounded.withColumn("citations", F.concat_ws(",", "citations"))


# Fixed value: citations that a short answer shows.
SHOWN_CITATIONS = 8


@query("citation_cap", f"""
WITH cited AS (
  SELECT answer_id, query_id, unnest(string_split(replace(cites, '"', ''), ',')) AS cid,
         unnest(range(0, len(string_split(cites, ',')))) AS pos FROM $answers),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS r FROM cited c
  WHERE EXISTS (SELECT 1 FROM $evidence e WHERE e.query_id = c.query_id AND e.citation_id = c.cid AND e.text <> ''))
SELECT a.answer_id, len(string_split(a.cites, ',')) AS given,
       CASE WHEN a.claims THEN coalesce(string_agg(r.cid, ',' ORDER BY r.pos) FILTER (r.r <= {SHOWN_CITATIONS}), '') ELSE '' END AS kept
FROM $answers a LEFT JOIN ranked r ON r.answer_id = a.answer_id GROUP BY a.answer_id, a.cites, a.claims""")
def _(load):
    answers = load("answers").withColumns({"grounded": F.col("claims"), "citations": F.split(F.replace("cites", F.lit('"'), F.lit("")), ",")})
    shown = grounding.ground_citations(answers, load("evidence"), limit=SHOWN_CITATIONS)
    given = answers.select("answer_id", F.size("citations").cast("bigint").alias("given"))
    return shown.join(given, "answer_id").select("answer_id", "given", F.concat_ws(",", "citations").alias("kept"))


@query("window_requests", f"""
WITH RECURSIVE {duck_normalised()}, {WINDOWS},
t AS (SELECT lecture_id, (n - 1) // 120 AS window_id,
             '[' || string_agg(to_json({{'start_ms': start_ms, 'end_ms': end_ms, 'text': text}})::VARCHAR, ',' ORDER BY n) || ']' AS transcript
      FROM norm GROUP BY ALL),
p AS (SELECT w.lecture_id, w.window_id, string_agg(to_json({{'page_num': s.page_num, 'created_sec': s.created_sec,
             'text': s.dhash}})::VARCHAR, ',' ORDER BY s.ord) AS pages
      FROM windows w JOIN $slides s ON s.lecture_id = w.lecture_id AND s.created_sec * 1000 BETWEEN w.lower_ms AND w.upper_ms
      GROUP BY ALL)
SELECT t.lecture_id, t.window_id, CAST(0 AS BIGINT) AS part,
       '{{"transcript":' || transcript || ',"ppt_pages":[' || coalesce(pages, '') || ']}}' AS request
FROM t LEFT JOIN p ON p.lecture_id = t.lecture_id AND p.window_id = t.window_id""")
def _(load):
    clean = segments.normalise_segments(load("segments_a"))
    shown = load("slides").withColumnRenamed("dhash", "text")
    members = slides.slides_to_windows(shown, slides.assign_windows(clean))
    return slides.window_requests(slides.pack_transcript(clean), members)
