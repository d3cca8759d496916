"""Messages, progress, jobs and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import envelope_status, row_digest
from ..operators import align, enrich, grids, jobs, messages
from ..session import shared_dir
from ..sources import jobs as job_records
from . import inputs, q_align  # noqa: F401
from .registry import INPUTS, define_input, query

NOW = 1700002000

# Part messages of documents: some repeated, some lost, some of a wrong count, some no parts.
define_input("part_messages", """
SELECT doc_id % 200 AS task_id, doc_id AS ord,
       CASE WHEN doc_id % 200 = 7 THEN 'hello'
            WHEN doc_id % 23 = 0 THEN concat('control 1 part 1/1', {nl}, 'QUJD')
            ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'job ' ELSE ' ' END, 'part ',
                        CAST(CAST(floor(doc_id / 200) AS BIGINT) % 4 + 1 AS STRING), '/',
                        CASE WHEN doc_id % 200 = 11 AND doc_id > 600 THEN '5' WHEN doc_id % 200 = 12 THEN '0' ELSE '4' END, {nl},
                        replace(replace({b64:text}, {nl}, ''), '=', 'A'), {nl}) END AS body
FROM {documents}""")

define_input("job_json", """
SELECT o_orderkey, concat('{"schema":"job.v2","protocol_version":"2","task_id":"', md5(CAST(o_orderkey AS STRING)),
   '","job_kind":"learning_pack","created_at":', CAST(o_orderkey AS STRING), '.5,"expires_at":', CAST(o_orderkey + 60 AS STRING),
   ',"payload":{"mode":"fast","title":"T', CAST(o_custkey AS STRING), '","media":{"start_seconds":5,"extra":1},',
   '"source_session":{"provider":"runner-session-v1","course_id":"', CAST(o_custkey AS STRING), '","sub_id":"9","media":true}},',
   '"requested_outputs":["subtitle","ocr"],"secrets":{"source_credentials":{"account":"a","password":"p"}},',
   '"pipeline":{"version":"v', CAST(o_orderkey % 3 AS STRING), '"}}') AS job FROM {orders}""")

define_input("packs", """
SELECT o_orderkey AS job_id, CASE o_orderkey % 7 WHEN 0 THEN 'echo' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'summary'
         WHEN 3 THEN 'chapters' WHEN 4 THEN 'unknown' ELSE 'learning_pack' END AS job_kind,
       o_custkey % 2 = 0 AS has_slides, o_custkey % 3 = 0 AS want_subtitle, o_custkey % 5 = 0 AS want_answer,
       o_custkey % 7 = 0 AS want_ocr, o_custkey % 4 = 0 AS want_summary, o_custkey % 11 = 0 AS want_chapters
FROM {orders}""")

define_input("results", """
SELECT l_orderkey * 10 + l_linenumber AS result_id,
       md5(CAST(l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS STRING)) AS task_id,
       CASE WHEN l_linenumber = 3 THEN 'x' ELSE concat('h', CAST(l_orderkey % 1000 AS STRING)) END AS input_hash,
       CASE WHEN l_linenumber = 4 THEN 'none' WHEN l_linenumber = 5 THEN 'echo' ELSE 'subtitle' END AS job_kind
FROM {lineitem}""")


@query("split_parts", """
WITH b AS (SELECT doc_id, to_base64(encode(text)) AS b FROM documents WHERE text <> ''),
p AS (SELECT doc_id, b, unnest(range(0, (length(b) + 1023) // 1024)) AS i FROM b)
SELECT doc_id, i + 1 AS part, (length(b) + 1023) // 1024 AS total, substr(b, i * 1024 + 1, 1024) AS piece FROM p""")
def _(load):
    return messages.split_parts(load("documents"), ["doc_id"], "text", size=1024)


PARTS = """m AS (SELECT task_id, ord, trim(body, ' ' || chr(10) || chr(9)) AS body FROM $part_messages),
p AS (SELECT task_id, ord, CAST(regexp_extract(body, 'part (\\d+)/', 1) AS BIGINT) AS part,
             CAST(regexp_extract(body, '/(\\d+)', 1) AS BIGINT) AS total, string_split(body, chr(10))[2] AS piece
      FROM m WHERE regexp_full_match(body, '(job )?part \\d+/\\d+\\n[A-Za-z0-9+/=]+')),
d AS (SELECT task_id, part, arg_max(piece, ord) AS piece, min(total) AS low, max(total) AS high FROM p GROUP BY ALL),
s AS (SELECT task_id, max(high) AS total, count(*) AS received, CAST(sum(length(piece)) AS BIGINT) AS chars,
             CASE WHEN min(low) <> max(high) THEN 'part_count_mismatch'
                  WHEN max(high) <= 0 OR list_sort(list(part)) <> range(1, max(high) + 1) THEN 'incomplete' ELSE 'complete' END AS status,
             string_agg(piece, '' ORDER BY part) AS payload FROM d GROUP BY task_id)"""


@query("reassemble_parts", f"""
WITH {PARTS} SELECT task_id, total, received, chars, status, CASE WHEN status = 'complete' THEN payload END AS payload FROM s""")
def _(load):
    parts = load("part_messages")
    whole = messages.join_parts(messages.complete_parts(parts, ["task_id"]), ["task_id"])
    return messages.reassemble_parts(parts, ["task_id"]).join(whole, "task_id", "left")


@query("decode_payload", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_object' WHEN 2 THEN 'not_json' WHEN 3 THEN 'not_base64' WHEN 4 THEN 'not_json' END AS decode_status,
       CASE WHEN page_id % 6 = 0 THEN '{"page":' || CAST(page_id AS VARCHAR) || ',"url":"' || url || '"}' END AS document FROM pages""")
def _(load):
    text = F.concat(F.lit('{"page":'), F.col("page_id").cast("string"), F.lit(',"url":"'), F.col("url"), F.lit('"}'))
    coded = lambda value: F.regexp_replace(F.base64(value), r"\s", "")
    kind = F.col("page_id") % 6
    payload = (F.when(kind == 0, coded(F.encode(text, "UTF-8"))).when(kind == 1, coded(F.lit(b"[1]"))).when(kind == 2, coded(F.encode("url", "UTF-8")))
               .when(kind == 3, F.lit("*")).when(kind == 4, coded(F.lit(bytes([0xC3, 0x28])))))
    return messages.decode_payload(load("pages").select("page_id", payload.alias("payload"))).select("page_id", "decode_status", "document")


@query("complete_parts", f"""
WITH {PARTS} SELECT task_id, part, piece FROM d WHERE task_id IN (SELECT task_id FROM s WHERE status = 'complete')""")
def _(load):
    return messages.complete_parts(load("part_messages"), ["task_id"])


@query("sequence_guard", """
WITH c AS (SELECT *, input_hash = 'h' || CAST(task_id AS VARCHAR) AS genuine,
                  control_kind IN ('progress', 'checkpoint', 'refresh_request', 'cancel_ack') AS known FROM $control)
SELECT arrival, task_id, sequence, CASE WHEN NOT genuine THEN 'tampered' WHEN NOT known THEN 'unknown_kind'
         WHEN sequence <= max(CASE WHEN genuine AND known THEN sequence END)
              OVER (PARTITION BY task_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'out_of_sequence'
         ELSE 'accepted' END AS status FROM c""")
def _(load):
    expected = load("control").select("task_id", F.concat(F.lit("h"), F.col("task_id").cast("string")).alias("expected_hash")).distinct()
    return messages.sequence_guard(load("control"), expected, ["task_id"]).select("arrival", "task_id", "sequence", "status")


SANITISED = """clean AS (SELECT task_id, arrival, at_us, stage, substr(stage, 1, 80) AS stage_short,
    CASE WHEN status IN ('running', 'waiting', 'failed', 'completed') THEN status ELSE 'running' END AS status,
    CASE WHEN completed IS NOT NULL THEN greatest(completed, 0) END AS completed,
    CASE WHEN total IS NOT NULL THEN greatest(total, 0) END AS total, error_code, substr(error_code, 1, 80) AS error_code_short FROM $progress)"""


@query("progress_sanitise", f"WITH {SANITISED} SELECT * FROM clean")
def _(load):
    return messages.sanitise_progress(load("progress"))


# The publisher itself, message by message.
def _throttled(source: str, forced: str) -> str:
    return f"""
WITH RECURSIVE {SANITISED.replace("$progress", source)},
n AS (SELECT c.*, p.{forced} AS force, row_number() OVER (PARTITION BY c.task_id ORDER BY c.at_us, c.arrival) AS n
      FROM clean c JOIN (SELECT arrival, {forced} FROM {source}) p ON p.arrival = c.arrival),
f AS (
  SELECT task_id, n, arrival, true AS send, stage, status, at_us, coalesce(completed, 0) AS done FROM n WHERE n = 1
  UNION ALL
  SELECT task_id, n, arrival, go, CASE WHEN go THEN stage ELSE old_stage END, CASE WHEN go THEN status ELSE old_status END,
         CASE WHEN go THEN at_us ELSE old_at END, CASE WHEN go THEN done ELSE old_done END
  FROM (SELECT n.task_id, n.n, n.arrival, n.stage, n.status, n.at_us, coalesce(n.completed, 0) AS done,
               f.stage AS old_stage, f.status AS old_status, f.at_us AS old_at, f.done AS old_done,
               n.force OR n.stage <> f.stage OR n.status <> f.status OR n.at_us - f.at_us >= 15000000
               OR (coalesce(n.total, 0) > 0 AND coalesce(n.completed, 0) - f.done
                   >= greatest(1, CAST(floor(n.total * 0.02e0) AS BIGINT))) AS go
        FROM f JOIN n ON n.task_id = f.task_id AND n.n = f.n + 1))
SELECT task_id, arrival FROM f WHERE send"""


define_input("forced_progress", INPUTS["progress"].replace("AS error_code\nFROM", "AS error_code, event_id % 23 = 0 AS force, false AS never\nFROM"))


@query("progress_throttle", _throttled("$forced_progress", "never"))
def _(load):
    return messages.progress_throttle(load("progress"), ["task_id"]).select("task_id", "arrival")


@query("progress_throttle_forced", _throttled("$forced_progress", "force"))
def _(load):
    return messages.progress_throttle(load("forced_progress"), ["task_id"], force="force").select("task_id", "arrival")


@query("envelope_check", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'not_base64' WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'not_base64'
       ELSE 'ok' END AS status FROM documents""")
def _(load):
    encoded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    kind = F.col("doc_id") % 5
    sealed = (F.when(kind == 0, F.concat(F.lit("*"), encoded)).when(kind == 2, F.concat(encoded, F.lit("A"))).otherwise(encoded))
    digest = F.when(kind == 1, F.sha2("source", 256)).otherwise(F.sha2("text", 256))
    return load("documents").select("doc_id", envelope_status(sealed, digest).alias("status"))


@query("row_digest", """
SELECT o_orderkey, sha256(to_json({'course_id': CAST(o_custkey AS VARCHAR), 'sub_id': CAST(o_orderkey AS VARCHAR),
       'title': CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'zürich "' || o_orderpriority || '"' END})::VARCHAR) AS digest
FROM orders""")
def _(load):
    rows = load("orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("course_id"), F.col("o_orderkey").cast("string").alias("sub_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('zürich "'), "o_orderpriority", F.lit('"'))).alias("title"))
    return rows.select("o_orderkey", row_digest(["title", "sub_id", "course_id"]).alias("digest"))


@query("job_validate", f"""
SELECT task_id, sub_id, CASE
  WHEN schema <> 'job.v2' THEN 'job schema must be job.v2'
  WHEN NOT regexp_full_match(task_id, '[0-9a-f]{{32}}') THEN 'task_id must be a 32-character lowercase UUID hex value'
  WHEN protocol_version <> '2' THEN 'unsupported protocol version'
  WHEN job_kind = 'other' THEN 'unsupported job kind'
  WHEN created_at <= 0 OR expires_at <= created_at THEN 'invalid job validity window'
  WHEN expires_at - created_at > 1800 THEN 'job validity window is too long'
  WHEN created_at > {NOW} + 120 THEN 'job was created in the future'
  WHEN expires_at < {NOW} - 120 THEN 'job has expired'
  WHEN result_public_key = 'YWJj' THEN 'result_public_key has the wrong length'
  WHEN CAST(sub_id AS BIGINT) % 61 = 0 THEN 'job payload must be an object'
  WHEN CAST(sub_id AS BIGINT) % 67 IN (0, 1) THEN 'requested_outputs must be a string list'
  WHEN CAST(sub_id AS BIGINT) % 71 IN (0, 1) AND CAST(sub_id AS BIGINT) % 73 <> 0 THEN 'media must be an object'
  WHEN start_seconds < 0 THEN 'media.start_seconds cannot be negative'
  WHEN duration_seconds <= 0 THEN 'media.duration_seconds must be positive'
  WHEN provider = 'old-session' THEN 'source_session provider is unsupported'
  WHEN provider IS NOT NULL AND course_id = 'x1' THEN 'source_session course_id is invalid'
  WHEN provider IS NOT NULL AND NOT wants_media AND NOT wants_slides THEN 'source_session requested no resources'
  WHEN provider IS NOT NULL AND account = '' THEN 'source_session credentials are invalid'
  WHEN NOT digest_ok THEN 'job input_hash does not match its payload' END AS error FROM $jobs""")
def _(load):
    parts = ["task_id", "job_kind", "schema", "protocol_version", "created_at", "expires_at", "course_id", "sub_id", "title"]
    rows = load("jobs").withColumn("expected_hash", row_digest(parts)).withColumn(
        "input_hash", F.when(F.col("digest_ok"), F.col("expected_hash")).otherwise("00"))
    rows = rows.withColumn("document", F.expr("""
        concat('{"payload":', CASE WHEN CAST(sub_id AS BIGINT) % 61 = 0 THEN '[1]' WHEN CAST(sub_id AS BIGINT) % 73 = 0 THEN 'null'
            ELSE concat('{"media":', CASE CAST(sub_id AS BIGINT) % 71 WHEN 0 THEN '"x"' WHEN 1 THEN 'false' WHEN 2 THEN 'null' ELSE '{}' END, '}') END,
            ',"requested_outputs":', CASE CAST(sub_id AS BIGINT) % 67 WHEN 0 THEN '"ocr"' WHEN 1 THEN '["ocr",5]' WHEN 2 THEN 'null' WHEN 3 THEN '[]' ELSE '["ocr"]' END, '}')"""))
    return jobs.validate_jobs(rows, F.lit(NOW), "document").select("task_id", "sub_id", "error")


@query("job_source", """
SELECT md5(CAST(o_orderkey AS VARCHAR)) AS task_id, CAST(o_orderkey AS DOUBLE) + 0.5 AS created_at,
       'T' || CAST(o_custkey AS VARCHAR) AS title, CAST(5 AS DOUBLE) AS start_seconds, CAST(NULL AS DOUBLE) AS duration_seconds,
       CAST(o_custkey AS VARCHAR) AS course_id, CAST(NULL AS BOOLEAN) AS wants_slides, 'subtitle,ocr' AS outputs,
       'v' || CAST(o_orderkey % 3 AS VARCHAR) AS version FROM orders""")
def _(load):
    read = job_records.read_jobs(load("job_json"))
    assert "secrets" not in read.columns
    return read.select(
        "task_id", "created_at", "payload.title", "payload.media.start_seconds", "payload.media.duration_seconds",
        "payload.source_session.course_id", F.col("payload.source_session.slides").alias("wants_slides"),
        F.concat_ws(",", "requested_outputs").alias("outputs"), "pipeline.version")


def packs(load):
    wanted = [F.when(F.col(f"want_{n}"), F.lit(n)) for n in ("subtitle", "answer", "ocr", "summary", "chapters")]
    return load("packs").withColumn("requested_outputs", F.array_compact(F.array(*wanted)))


@query("route_outputs", """
WITH p AS (SELECT *, job_kind = 'learning_pack' AS pack, job_kind IN ('summary', 'chapters') AS notes FROM $packs)
SELECT job_id, 'echo' AS step FROM p WHERE job_kind = 'echo'
UNION ALL SELECT job_id, 'subtitle' FROM p WHERE job_kind = 'subtitle' OR pack AND want_subtitle
UNION ALL SELECT job_id, 'answer' FROM p WHERE pack AND want_answer
UNION ALL SELECT job_id, 'slides' FROM p WHERE has_slides AND (notes OR pack AND (want_ocr OR want_summary OR want_chapters))
UNION ALL SELECT job_id, 'output:ppt_pages' FROM p WHERE notes OR pack AND want_ocr
UNION ALL SELECT job_id, 'summarise' FROM p WHERE notes OR pack AND (want_summary OR want_chapters)
UNION ALL SELECT job_id, 'output:summary' FROM p WHERE job_kind = 'summary' OR pack AND want_summary
UNION ALL SELECT job_id, 'output:chapters' FROM p WHERE job_kind = 'chapters' OR pack AND want_chapters""")
def _(load):
    return jobs.route_outputs(packs(load), ["job_id"])


@query("outputs_intersect", """
SELECT job_id, concat_ws(',', CASE WHEN want_ocr THEN 'ocr' END, CASE WHEN want_summary THEN 'summary' END,
       CASE WHEN want_chapters THEN 'chapters' END) AS needs_slides FROM $packs""")
def _(load):
    return packs(load).select("job_id", F.concat_ws(",", jobs.slide_outputs()).alias("needs_slides"))


@query("resume_windows", """
SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS window_id,
       CASE WHEN l_orderkey % 5 = 0 AND l_orderkey % 15 <> 0 THEN 'checkpoint_mode_mismatch' ELSE 'todo' END AS status
FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber < 3)""")
def _(load):
    windows = load("lineitem").select(F.col("l_orderkey").alias("job_id"), F.lit("proofread").alias("stage"),
                                      F.col("l_linenumber").cast("bigint").alias("window_id"), F.lit("standard").alias("mode"))
    finished = (F.col("job_id") % 3 == 0) & (F.col("window_id") < 3)
    done = windows.select("job_id", "stage", F.when(finished, F.col("window_id")).otherwise(-1).alias("window_id"))
    saved = load("orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("proofread").alias("stage"),
        F.expr("CASE WHEN o_orderkey % 15 = 0 THEN 'standard' WHEN o_orderkey % 5 = 0 THEN 'fast' END").alias("checkpoint_mode"))
    return jobs.resume_windows(windows, done, saved, ["job_id", "stage"]).select("job_id", "window_id", "status")


@query("reconcile_results", """
WITH j AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS task_id, 'h' || CAST(o_orderkey % 1000 AS VARCHAR) AS input_hash,
                  CASE WHEN o_orderkey % 6 = 0 THEN 'summary' ELSE 'subtitle' END AS job_kind FROM orders)
SELECT r.task_id, r.result_id, CASE WHEN j.task_id IS NULL THEN 'orphan' WHEN r.input_hash <> j.input_hash THEN 'input_hash_mismatch'
       WHEN r.job_kind = 'none' THEN 'job_kind_invalid' WHEN r.job_kind <> j.job_kind THEN 'job_kind_mismatch' ELSE 'ok' END AS status
FROM $results r LEFT JOIN j USING (task_id)
UNION ALL
SELECT task_id, NULL, 'missing' FROM j WHERE task_id NOT IN (SELECT task_id FROM $results)""")
def _(load):
    expected = load("orders").select(
        F.md5(F.col("o_orderkey").cast("string")).alias("task_id"),
        F.concat(F.lit("h"), (F.col("o_orderkey") % 1000).cast("string")).alias("input_hash"),
        F.when(F.col("o_orderkey") % 6 == 0, "summary").otherwise("subtitle").alias("job_kind"))
    return jobs.reconcile_results(expected, load("results"))


def _sources(load):
    asked = load("jobs").select("task_id", F.col("sub_id").cast("bigint").alias("job_id"), "wants_media", "wants_slides", "account",
                                (F.col("sub_id").cast("bigint") % 300).alias("lecture_id"))
    media = load("pages").select(F.col("page_id").alias("lecture_id"), F.col("url").alias("media_url"))
    pages = load("documents").select((F.col("doc_id") % 300).alias("lecture_id"), F.col("doc_id").alias("slide_id"))
    return asked, media, pages


@query("materialise_sources", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 <> 0 THEN p.url END AS media_url,
       CASE WHEN o_orderkey % 8 <> 0 THEN coalesce(d.n, 0) ELSE 0 END AS slides
FROM orders LEFT JOIN pages p ON p.page_id = o_orderkey % 300
LEFT JOIN (SELECT doc_id % 300 AS k, count(*) AS n FROM documents GROUP BY 1) d ON d.k = o_orderkey % 300""")
def _(load):
    asked, media, pages = _sources(load)
    return jobs.materialise_sources(asked, media, pages, ["lecture_id"]).select("job_id", "media_url", "slides")


@query("requested_slides", """
SELECT doc_id % 300 AS lecture_id, doc_id AS slide_id FROM documents
WHERE doc_id % 300 IN (SELECT o_orderkey % 300 FROM orders WHERE o_orderkey % 8 <> 0)""")
def _(load):
    asked, _, pages = _sources(load)
    return jobs.requested_slides(asked, pages, ["lecture_id"])


@query("result_sink", """
SELECT 'h' || CAST(o_custkey AS VARCHAR) AS input_hash, min(o_orderkey) AS result_id FROM orders GROUP BY 1""")
def _(load):
    import uuid

    rows = load("orders").select(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("input_hash"),
                                 F.col("o_orderkey").alias("result_id"))
    path = f"{shared_dir(load.spark)}/results-{uuid.uuid4().hex}"
    for _ in range(2):  # a repeated delivery stores nothing new
        job_records.write_results(rows, path, "result_id")
    return job_records.read_results(load.spark, path)


@query("chunk_grid", """
WITH r AS (SELECT o_orderkey, o_orderkey % 50 - 2 AS s, o_totalprice / 7 AS d FROM orders),
e AS (SELECT *, CASE WHEN s < 0 THEN 'invalid_start' WHEN NOT (d > 0 AND d <= 43200) THEN 'invalid_duration' END AS recording_error FROM r),
c AS (SELECT *, unnest(CASE WHEN recording_error IS NULL THEN range(0, CAST(ceil(d / 600) AS BIGINT)) ELSE [NULL] END) AS chunk_id FROM e)
SELECT o_orderkey, chunk_id, CAST(s + chunk_id * 600 AS DOUBLE) AS offset_seconds,
       CASE WHEN chunk_id IS NOT NULL THEN least(600, d - chunk_id * 600) END AS duration_seconds, recording_error FROM c""")
def _(load):
    recordings = load("orders").select("o_orderkey", (F.col("o_orderkey") % 50 - 2).alias("start_seconds"),
                                       (F.col("o_totalprice") / 7).alias("duration_seconds"))
    return grids.chunk_grid(recordings, ["o_orderkey"])


@query("asr_window_grid", """
WITH c AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 17 AS samples, o_orderkey * 0.5 AS offset_s FROM orders),
w AS (SELECT *, unnest(range(0, (samples + 479999) // 480000)) AS window_id FROM c)
SELECT o_orderkey, window_id, CAST(floor(offset_s * 1000) AS BIGINT) + window_id * 480000 // 16 AS start_ms,
       CAST(floor(offset_s * 1000) AS BIGINT) + least(samples, window_id * 480000 + 480000) // 16 AS end_ms,
       least(samples, window_id * 480000 + 480000) - window_id * 480000 < 8000 AS short FROM w""")
def _(load):
    chunks = load("orders").select("o_orderkey", (F.floor("o_totalprice").cast("bigint") * 17).alias("samples"),
                                   (F.col("o_orderkey") * 0.5).alias("offset_seconds"))
    return grids.window_grid(chunks, ["o_orderkey"])


def _stub_model():
    import json

    def answer(request: str) -> str:
        items = json.loads(request)
        return json.dumps([{"index": i["index"], "text": f"fixed {i['index']}"} for i in items if i["index"] % 2 == 0])

    return answer


# Requests through a stub model and back: even positions are corrected. The
# responses are logged before they are used, so every request is asked once.
@query("enrich_windows", f"""
WITH RECURSIVE {q_align.PAIRS},
merged AS (SELECT lecture_id, idx AS ord, start_ms, end_ms, CASE WHEN idx % 2 = 0 THEN 'fixed ' || CAST(idx AS VARCHAR)
           ELSE coalesce(nullif(text_b, ''), text_a) END AS text FROM pairs),
{q_align.duck_normalised('merged')}
SELECT lecture_id, n - 1 AS ord, start_ms, end_ms, text FROM norm""")
def _(load):
    pairs = q_align.pairs(load)
    responses = enrich.enrich_windows(align.pack_requests(pairs), _stub_model)
    corrections = align.parse_corrections(responses).where("status = 'ok'")
    return align.corrected_segments(pairs, corrections, sized_by=q_align.pair_keys(load))
