"""Input tables derived from the test tables, in SQL that both engines accept."""

from .registry import define_input

# A lecture is 25 conversations long, so windows of 20 and 120 rows are filled. The
# second recogniser's lectures begin one conversation earlier, so list lengths differ.
define_input("segments_a", """
SELECT CAST(floor(conv_id / 25) AS BIGINT) AS lecture_id, conv_id * 100 + turn AS ord,
       (conv_id % 25) * 24000 + turn * 3000 - (length(text) % 5) * 700 AS start_ms,
       CASE WHEN turn % 4 = 3 THEN NULL
            WHEN turn % 7 = 6 THEN 0
            ELSE (conv_id % 25) * 24000 + turn * 3000 + length(text) * 15 END AS end_ms,
       CASE WHEN turn % 5 = 4 THEN '   ' ELSE text END AS text
FROM {conversations}""")

define_input("segments_b", """
SELECT CAST(floor((conv_id + 1) / 25) AS BIGINT) AS lecture_id, conv_id * 100 + turn AS ord,
       (conv_id % 25) * 24000 + turn * 3000 AS start_ms,
       (conv_id % 25) * 24000 + turn * 3000 + 2500 AS end_ms,
       CASE WHEN turn % 4 = 2 THEN '' ELSE concat('B: ', text) END AS text
FROM {conversations}""")

define_input("corrections", """
SELECT CAST(floor(conv_id / 25) AS BIGINT) AS lecture_id, (conv_id % 25) * 5 + turn AS idx,
       conv_id * 100 + turn AS ord,
       CASE WHEN turn % 4 < 2 THEN '' ELSE concat('fixed ', CAST(conv_id AS STRING)) END AS text
FROM {conversations}""")

define_input("slides", """
SELECT page_id % 8 AS lecture_id, page_id AS ord,
       CASE WHEN page_id % 9 = 0 THEN 0 ELSE CAST(floor(page_id / 50) AS BIGINT) * 2 + 1 END AS page_num,
       (page_id * 7) % 700 AS created_sec,
       CASE WHEN page_id % 11 = 0 THEN '' ELSE substr(md5(CAST(page_id % 97 AS STRING)), 1, 16) END AS dhash
FROM {pages}""")

define_input("lectures", """
SELECT o_custkey AS course_id, o_orderkey AS sub_id, CAST(o_orderdate AS DATE) AS lecture_date,
       o_orderstatus <> 'P' AS has_playback,
       CAST(floor(o_totalprice) AS BIGINT) % 20000 AS duration_seconds
FROM {orders}""")

# A quarter of the rules belong to no course, and as many courses have no rule.
define_input("rules", """
SELECT CASE WHEN c_custkey % 4 = 3 THEN -c_custkey ELSE c_custkey END AS course_id, c_custkey AS ord, c_custkey % 3 = 0 AS discovery_only,
       c_custkey % 5 AS priority,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'standard' WHEN 'MACHINERY' THEN 'no-proofread'
            WHEN 'HOUSEHOLD' THEN NULL ELSE 'fast' END AS subtitle_mode,
       c_custkey % 2 = 0 AS ocr, c_custkey % 7 = 0 AS summary, c_custkey % 11 = 0 AS chapters,
       60 * (1 + c_custkey % 4) AS max_lecture_minutes
FROM {customer}""")

define_input("seen", """
SELECT o_custkey AS course_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE -o_orderkey END AS sub_id FROM {orders}
UNION ALL
SELECT o_custkey AS course_id, CASE WHEN o_orderkey % 15 = 0 THEN o_orderkey ELSE -o_orderkey END AS sub_id FROM {orders}""")

define_input("attempts", """
SELECT event_id, user_id AS key_id, {ts_us} AS at_us,
       CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'ok'
            WHEN 'purchase' THEN (CASE WHEN event_id % 3 = 0 THEN 'auth_failed' ELSE 'transient' END)
            ELSE 'other' END AS outcome,
       CAST(floor(value) AS BIGINT) - 3 AS tokens
FROM {events}""")

define_input("control", """
SELECT event_id AS arrival, user_id AS task_id, (event_id * 7919) % 1000 AS sequence,
       CASE WHEN event_id % 13 = 0 THEN 'tampered' ELSE concat('h', CAST(user_id AS STRING)) END AS input_hash,
       CASE event_type WHEN 'error' THEN 'cancel_ack' WHEN 'signup' THEN 'checkpoint'
            WHEN 'purchase' THEN 'note' ELSE 'progress' END AS control_kind,
       {ts_us} AS at_us, value
FROM {events}""")

define_input("progress", """
SELECT user_id AS task_id, event_id AS arrival, {ts_us} AS at_us,
       CASE WHEN event_id % 10 < 7 THEN 'asr' ELSE 'ocr' END AS stage,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'odd' ELSE 'running' END AS status,
       CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value) AS BIGINT) - 20 END AS completed,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(5000 AS BIGINT) END AS total,
       concat('code ', repeat('x', CAST(event_id % 100 AS INT))) AS error_code
FROM {events}""")

define_input("responses", """
SELECT page_id,
       CASE page_id % 11 WHEN 0 THEN 200 WHEN 1 THEN 206 WHEN 2 THEN 302 WHEN 3 THEN 403 WHEN 4 THEN 404
            WHEN 5 THEN 418 WHEN 6 THEN 503 WHEN 7 THEN 200 WHEN 8 THEN 200 WHEN 9 THEN 429 ELSE 0 END AS status,
       CASE page_id % 7 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Video/mp4'
            WHEN 2 THEN 'application/problem+json' WHEN 3 THEN '' WHEN 4 THEN NULL
            WHEN 5 THEN 'application/json ;v=1' ELSE 'image/png' END AS content_type,
       CASE page_id % 5 WHEN 0 THEN 'abcdftypisom0000' WHEN 1 THEN '  {"error":1}' WHEN 2 THEN 'zz'
            WHEN 3 THEN 'abcdftyp' ELSE (CASE WHEN page_id % 3 = 0 THEN concat(repeat(' ', 90), html) ELSE html END) END AS prefix
FROM {pages}""")

define_input("urls", """
SELECT page_id, CASE page_id % 11 WHEN 0 THEN concat('https://u:p@h.example.com/', CAST(page_id AS STRING))
            WHEN 1 THEN 'https://h.example.com:8443/x' WHEN 2 THEN 'https://H.example.com:443/x?y#z'
            WHEN 3 THEN 'HTTPS://h.example.com/x' WHEN 4 THEN 'https:///nohost' WHEN 5 THEN NULL
            ELSE url END AS url
FROM {pages}""")

# Redirect chains inside runs of 20 pages, some longer than the hop limit, some closed.
define_input("hops", """
SELECT concat('https://', CASE WHEN page_id % 7 < 4 THEN 'a' ELSE 'b' END, '.example.com/p',
              CAST(page_id AS STRING)) AS url, page_id AS ord,
       CASE WHEN page_id % 20 IN (2, 5, 19) THEN (CASE WHEN page_id % 3 = 0 THEN 404 ELSE 200 END)
            ELSE 302 END AS status,
       CASE WHEN page_id % 20 = 9 THEN NULL
            WHEN page_id % 20 IN (2, 5, 19) THEN NULL
            WHEN page_id % 20 = 7 THEN concat('https://', CASE WHEN page_id % 7 < 4 THEN 'a' ELSE 'b' END,
                                              '.example.com/p', CAST(page_id AS STRING))
            ELSE concat('https://', CASE WHEN (page_id + 1) % 7 < 4 THEN 'a' ELSE 'b' END,
                        '.example.com/p', CAST(page_id + 1 AS STRING)) END AS location
FROM {pages}""")

define_input("jobs", """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'BAD' ELSE md5(CAST(o_orderkey AS STRING)) END AS task_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'echo' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'summary'
            WHEN 3 THEN 'chapters' WHEN 4 THEN 'learning_pack' ELSE 'other' END AS job_kind,
       CASE WHEN o_orderkey % 41 = 0 THEN 'job.v1' ELSE 'job.v2' END AS schema,
       CASE WHEN o_orderkey % 43 = 0 THEN '1' ELSE '2' END AS protocol_version,
       CASE WHEN o_orderkey % 47 = 0 THEN 0 ELSE 1700000000 + o_orderkey % 5000 END AS created_at,
       1700000000 + o_orderkey % 5000 + (o_orderkey % 2500) - 100 AS expires_at,
       CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_orderkey % 100 END AS start_seconds,
       CASE WHEN o_orderkey % 23 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN NULL ELSE 600 + o_custkey END AS duration_seconds,
       CASE WHEN o_orderkey % 29 = 0 THEN 'x1' ELSE CAST(o_custkey AS STRING) END AS course_id,
       CAST(o_orderkey AS STRING) AS sub_id, o_orderkey % 4 <> 0 AS wants_media, o_orderkey % 8 <> 0 AS wants_slides,
       CASE WHEN o_orderkey % 31 = 0 THEN 'old-session' WHEN o_orderkey % 2 = 0 THEN NULL
            ELSE 'runner-session-v1' END AS provider,
       CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'acct' END AS account, 'secret' AS password,
       CASE WHEN o_orderkey % 53 = 0 THEN 'YWJj' ELSE 'MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDE=' END AS result_public_key,
       concat('title ', CAST(o_custkey AS STRING)) AS title, o_orderkey % 59 <> 0 AS digest_ok
FROM {orders}""")

define_input("evidence", """
SELECT doc_id % 50 AS query_id, CAST(doc_id AS STRING) AS citation_id,
       CASE WHEN doc_id % 13 = 0 OR doc_id % 50 = 7 THEN '' ELSE text END AS text
FROM {documents}""")
