"""Policies, URLs, responses, manifests and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, urls
from ..operators import integrity, policy, redirects
from ..sources import files as file_source
from . import inputs  # noqa: F401
from .registry import define_input, query

define_input("errors", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'asr' WHEN 1 THEN 'source' ELSE 'platform' END AS family,
       CASE page_id % 17
         WHEN 0 THEN 'media start is invalid' WHEN 3 THEN 'authorized media request returned HTTP 403'
         WHEN 1 THEN 'source host has no addresses' WHEN 4 THEN concat('source request failed: ', url)
         WHEN 2 THEN 'platform_auth_failed' WHEN 5 THEN 'platform_connection_failed'
         WHEN 7 THEN 'source image returned HTTP 500' ELSE url END AS message,
       CASE WHEN page_id % 2 = 0 THEN 'course_request' ELSE 'odd' END AS stage
FROM {pages}""")

define_input("stderr", """
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'x Server returned 404 Not Found' WHEN 1 THEN 'HTTP error 429, moov atom'
    WHEN 2 THEN 'requested URL returned error: 401' WHEN 3 THEN 'server returned 5XX' WHEN 4 THEN 'MOOV ATOM not found; Invalid data'
    WHEN 5 THEN 'Invalid data found' WHEN 6 THEN NULL WHEN 7 THEN 'http error 403 after http error 401' ELSE html END AS stderr
FROM {pages}""")

define_input("addresses", """
SELECT page_id % 60 AS host_id, page_id AS ord,
       CASE WHEN page_id % 9 = 0 AND page_id % 60 >= 20 THEN '2606:4700::1'
            WHEN page_id % 9 = 0 THEN (CASE page_id % 8 WHEN 0 THEN '::1' WHEN 1 THEN 'fd00::5' WHEN 2 THEN 'FE80::1' WHEN 3 THEN '::ffff:10.0.0.1'
                 WHEN 4 THEN 'junk' WHEN 5 THEN '::ffff:93.184.216.34' WHEN 6 THEN '2a00:1450:4001:80e::200e' ELSE '1::2::3' END)
            WHEN page_id % 31 = 0 THEN '93.184.216.034'
            ELSE concat(CASE page_id % 10 WHEN 0 THEN '10' WHEN 1 THEN '127' WHEN 2 THEN '172' WHEN 3 THEN '100' ELSE '93' END, '.',
                        CAST((page_id * 7) % 256 AS STRING), '.', CAST((page_id * 13) % 256 AS STRING), '.',
                        CAST(page_id % 256 AS STRING)) END AS ip
FROM {pages}""")

# Texts with planted violations; the planted part repeats so that it may stand anywhere.
define_input("files", """
SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN 'scripts/' WHEN 2 THEN 'worker/' ELSE 'other/' END,
                      CASE WHEN doc_id % 40 = 2 THEN 'connector' ELSE concat('f', CAST(doc_id AS STRING)) END,
                      CASE WHEN doc_id % 4 = 0 THEN '.md' WHEN doc_id % 7 = 0 THEN '.MP4' WHEN doc_id % 5 = 0 THEN '.yml' ELSE '.py' END) AS path,
       concat(text, {nl}, CASE doc_id % 9 WHEN 0 THEN 'see https://m.example.com/a.MP4?x=1 now' WHEN 1 THEN 'import src.api.iCourse'
              WHEN 2 THEN 'get_sub_info(student_id)' WHEN 3 THEN 'Password = hunter22' WHEN 4 THEN 'curl -L x.m3u8'
              WHEN 5 THEN 'webvpn.example.org and resume_download()' WHEN 6 THEN 'tempfile.mkstemp()' ELSE '' END) AS text
FROM {documents}""")

define_input("markdown", """
SELECT concat('docs/', CASE WHEN doc_id % 3 = 0 THEN 'deep/' ELSE '' END, 'd', CAST(doc_id AS STRING), '.md') AS path,
       concat(replace(text, '[', '('), {nl}, '[a](d', CAST(doc_id + 1 AS STRING), '.md#x) ![img](gone.png) [b](https://e.org) [c](#top) ',
              '[e](../docs/d', CAST(doc_id - 1 AS STRING), '.md "title") [f](<deep>) [g](../../../out.md) [h](d%31%30.md) [i](a+b.md)') AS text
FROM {documents}""")

define_input("manifest", """
SELECT l_suppkey AS release_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord,
       concat(CASE WHEN l_orderkey % 101 = 0 THEN '/' WHEN l_orderkey % 103 = 0 THEN '../' ELSE 'src/' END,
              CAST(l_partkey AS STRING), CASE WHEN l_orderkey % 107 = 0 THEN '' ELSE concat('/', CAST(l_linenumber AS STRING)) END) AS path,
       CASE WHEN l_orderkey % 11 = 0 THEN '100755' WHEN l_orderkey % 109 = 0 THEN '120000' ELSE '100644' END AS mode,
       CASE WHEN l_orderkey % 113 = 0 THEN NULL ELSE l_orderkey END AS size,
       CASE WHEN l_orderkey % 127 = 0 THEN 'zz' ELSE {sha256}(CAST(l_orderkey AS STRING){sha_arg}) END AS sha256
FROM {lineitem}""")

define_input("expected_files", """
SELECT p_partkey % 20 AS release_id, concat(CASE WHEN p_partkey % 7 = 0 THEN 'e' ELSE 'f' END, CAST(p_partkey AS STRING)) AS path,
       CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey * 3 END AS size,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {sha256}(CAST(p_partkey AS STRING){sha_arg}) END AS sha256 FROM {part}""")
define_input("actual_files", """
SELECT p_partkey % 20 AS release_id, concat(CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE 'f' END, CAST(p_partkey AS STRING)) AS path,
       p_partkey * 3 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS size,
       {sha256}(CAST(p_partkey + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS STRING){sha_arg}) AS sha256
FROM {part}""")

define_input("sessions", """
SELECT page_id % 40 AS session_id, page_id AS seq,
       CASE WHEN page_id % 7 = 0 THEN 'https://other.example.com/m.mp4?t=1'
            WHEN page_id % 5 = 0 THEN concat('HTTPS://CDN.example.com/m.mp4?t=', CAST(page_id AS STRING))
            WHEN page_id % 11 = 0 THEN 'https://cdn.example.com:443/m.mp4'
            ELSE concat('https://cdn.example.com/m.mp4?t=', CAST(page_id AS STRING)) END AS url
FROM {pages}""")

UPSTREAM = """CASE WHEN status IN (200, 206, 416) THEN NULL WHEN status IN (301, 302, 303, 307, 308) THEN 'upstream_redirect'
  WHEN status IN (401, 403, 404, 429) THEN 'upstream_http_' || CAST(status AS VARCHAR)
  WHEN status BETWEEN 500 AND 599 THEN 'upstream_http_5xx' ELSE 'upstream_http_other' END"""


@query("error_reduce", """
SELECT page_id, CASE
  WHEN family = 'asr' THEN CASE page_id % 17 WHEN 0 THEN 'invalid_start' WHEN 3 THEN 'media_http_403' ELSE 'asr_error' END
  WHEN family = 'source' THEN CASE page_id % 17 WHEN 1 THEN 'dns_no_addresses' WHEN 4 THEN 'connection_failed'
       WHEN 7 THEN 'image_http_error' ELSE 'source_security_error' END
  ELSE CASE WHEN page_id % 17 = 2 THEN 'platform_auth_failed'
            WHEN page_id % 17 = 5 AND stage = 'course_request' THEN 'platform_connection_failed_course_request'
            WHEN page_id % 17 = 5 THEN 'platform_connection_failed' ELSE 'platform_session_failed' END END AS code
FROM $errors""")
def _(load):
    return load("errors").select("page_id", codes.error_code("family", "message", "stage", ("course_request",)).alias("code"))


@query("upstream_status", f"SELECT page_id, {UPSTREAM} AS code FROM $responses")
def _(load):
    return load("responses").select("page_id", codes.upstream_code("status").alias("code"))


@query("stderr_reduce", """
SELECT page_id, CASE WHEN contains(t, 'server returned 401') OR contains(t, 'http error 401') OR contains(t, 'returned error: 401') THEN 'media_http_401'
  WHEN contains(t, 'server returned 403') OR contains(t, 'http error 403') OR contains(t, 'returned error: 403') THEN 'media_http_403'
  WHEN contains(t, 'server returned 404') OR contains(t, 'http error 404') OR contains(t, 'returned error: 404') THEN 'media_http_404'
  WHEN contains(t, 'server returned 429') OR contains(t, 'http error 429') OR contains(t, 'returned error: 429') THEN 'media_http_429'
  WHEN contains(t, 'server returned 5') OR contains(t, 'http error 5') THEN 'media_http_5xx'
  WHEN contains(t, 'moov atom') THEN 'media_index_unreadable' WHEN contains(t, 'invalid data') THEN 'media_format_rejected'
  ELSE 'media_decode_failed' END AS code
FROM (SELECT page_id, lower(coalesce(stderr, '')) AS t FROM $stderr)""")
def _(load):
    return load("stderr").select("page_id", codes.decoder_code("stderr").alias("code"))


PROFILE = """profile AS (
  SELECT page_id,
    CASE WHEN status IN (401, 403, 404, 429) THEN 'http_' || CAST(status AS VARCHAR) WHEN status BETWEEN 200 AND 599
         THEN 'http_' || CAST(status // 100 AS VARCHAR) || 'xx' ELSE 'http_other' END AS http,
    CASE WHEN t = '' THEN 'content_missing' WHEN t LIKE 'video/%' THEN 'content_video'
         WHEN t IN ('text/html', 'application/xhtml+xml') THEN 'content_html'
         WHEN t = 'application/json' OR t LIKE '%+json' THEN 'content_json' ELSE 'content_other' END AS content,
    CASE WHEN length(prefix) >= 12 AND substr(prefix, 5, 4) = 'ftyp' THEN 'magic_iso_bmff'
         WHEN regexp_matches(prefix, '^\\s*(<!doctype html|<html|<head|<body)', 'i') THEN 'magic_html'
         WHEN regexp_matches(prefix, '^\\s*[{\\[]') THEN 'magic_json' ELSE 'magic_unknown' END AS magic
  FROM (SELECT *, lower(trim(string_split(coalesce(content_type, ''), ';')[1])) AS t FROM $responses))"""


def profile(load):
    return load("responses").select(
        "page_id", codes.response_http("status").alias("http"), codes.response_content("content_type").alias("content"),
        codes.response_magic("prefix").alias("magic"))


@query("response_profile", f"WITH {PROFILE} SELECT * FROM profile")
def _(load):
    return profile(load)


@query("response_verdict", f"""
WITH {PROFILE}
SELECT page_id, CASE WHEN http IN ('http_401', 'http_403', 'http_404', 'http_429', 'http_4xx', 'http_5xx') THEN 'media_' || http
  WHEN http = 'http_3xx' THEN 'media_redirect_rejected' WHEN http = 'http_other' THEN 'media_http_status_rejected'
  WHEN content = 'content_html' OR magic = 'magic_html' THEN 'media_content_html'
  WHEN content = 'content_json' OR magic = 'magic_json' THEN 'media_content_json'
  WHEN magic <> 'magic_iso_bmff' THEN 'media_magic_rejected' END AS code FROM profile""")
def _(load):
    return profile(load).select("page_id", codes.response_verdict("http", "content", "magic").alias("code"))


@query("header_allowlist", """
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL
  ELSE 'Accept-Language=' || CAST(page_id AS VARCHAR) || ',Cookie=' || CASE WHEN page_id % 4 = 0 THEN 'last' ELSE 'c;User-Agent' END END AS headers FROM pages""")
def _(load):
    value = F.when(F.col("page_id") % 6 == 0, F.lit("a\r\nb")).otherwise(F.col("page_id").cast("string"))
    raw = F.create_map(F.lit(" ACCEPT-language"), value, F.lit("Host"), F.lit("a\nb"), F.lit("Range"), F.lit("r"),
                       F.lit("cookie"), F.lit("c;User-Agent"), F.when(F.col("page_id") % 4 == 0, "Cookie ").otherwise("X-Other"), F.lit("last"))
    kept = urls.safe_headers(raw)
    shown = F.concat_ws(",", F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    return load("pages").select("page_id", F.when(kept.isNotNull(), shown).alias("headers"))


@query("url_policy", """
SELECT page_id, CASE WHEN page_id % 11 IN (0, 4, 5) THEN 'invalid_https_url' WHEN page_id % 11 = 1 THEN 'invalid_https_port'
  WHEN page_id % 11 IN (2, 3) THEN 'ok' WHEN url LIKE 'https://%' THEN 'ok' ELSE 'invalid_https_url' END AS reason,
  CASE WHEN page_id % 11 IN (2, 3) THEN 'ok' WHEN page_id % 11 = 1 THEN 'invalid_https_port'
       WHEN page_id % 11 > 5 AND url LIKE 'https://%' THEN 'host_not_allowed' ELSE 'invalid_https_url' END AS listed
FROM $urls""")
def _(load):
    return load("urls").select("page_id", urls.url_reason("url").alias("reason"),
                               urls.url_reason("url", ["h.example.com"]).alias("listed"))


@query("same_media_identity", """
WITH s AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 1 WHEN page_id % 5 = 0 THEN 0 WHEN page_id % 11 = 0 THEN 2 ELSE 0 END AS kind
           FROM (SELECT *, seq AS page_id FROM $sessions))
SELECT session_id, seq, kind = first_value(kind) OVER (PARTITION BY session_id ORDER BY seq) AS accepted FROM s""")
def _(load):
    return redirects.same_media_identity(load("sessions"), ["session_id"]).select("session_id", "seq", "accepted")


@query("resolve_redirects", """
WITH RECURSIVE walk AS (
  SELECT ord AS start, url AS current, 0 AS tries, 0 AS redirects, true AS host_headers, CAST(NULL AS VARCHAR) AS status FROM $hops
  UNION ALL
  SELECT w.start, CASE WHEN h.status = 302 AND h.location IS NOT NULL THEN h.location ELSE w.current END, w.tries + 1,
         w.redirects + CASE WHEN h.status = 302 AND h.location IS NOT NULL THEN 1 ELSE 0 END,
         w.host_headers AND NOT (h.status = 302 AND h.location IS NOT NULL AND substr(h.location, 9, 1) <> substr(w.current, 9, 1)),
         CASE WHEN h.url IS NULL THEN 'connection_failed' WHEN h.status = 302 AND h.location IS NULL THEN 'redirect_without_location'
              WHEN h.status = 302 THEN NULL WHEN h.status >= 400 THEN 'authorization_http_error' ELSE 'ok' END
  FROM walk w LEFT JOIN $hops h ON h.url = w.current WHERE w.status IS NULL AND w.tries < 6)
SELECT start, current, redirects, coalesce(host_headers, true) AS host_headers, coalesce(status, 'redirect_limit') AS status
FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY tries DESC) AS r FROM walk) WHERE r = 1""")
def _(load):
    hops = load("hops")
    return redirects.resolve_redirects(hops.select(F.col("ord").alias("start"), "url"), hops, ["start"])


IPV4 = """ips AS (SELECT *, regexp_full_match(ip, '(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}') AS v4,
    [TRY_CAST(x AS BIGINT) FOR x IN string_split(ip, '.')] AS q FROM $addresses),
st AS (SELECT *, CASE WHEN ip LIKE '::ffff:93.%' THEN 'public' WHEN ip LIKE '::ffff:10.%' OR lower(ip) LIKE 'fe80:%' OR ip LIKE 'fd%' OR ip = '::1' THEN 'non_public'
       WHEN ip LIKE '2%:%' THEN 'public' WHEN NOT v4 THEN 'unreadable' WHEN q[1] IN (10, 127) OR q[1] = 172 AND q[2] BETWEEN 16 AND 31
       OR q[1] = 100 AND q[2] BETWEEN 64 AND 127 THEN 'non_public' ELSE 'public' END AS status FROM ips)"""


@query("non_public_address", f"WITH {IPV4} SELECT host_id, ord, ip, status FROM st")
def _(load):
    return load("addresses").withColumn("status", policy.address_status("ip"))


@query("preferred_address", f"""
WITH {IPV4}
SELECT host_id, CASE WHEN bool_or(status <> 'public') THEN 'non_public_address' ELSE 'ok' END AS status,
  CASE WHEN NOT bool_or(status <> 'public') THEN coalesce(arg_min(ip, ord) FILTER (v4), arg_min(ip, ord)) END AS preferred
FROM st GROUP BY host_id""")
def _(load):
    return policy.host_addresses(load("addresses"), ["host_id"])


@query("text_policy", """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'invalid_utf8' WHEN 1 THEN 'replacement_character' WHEN 2 THEN 'nul_byte' END AS problem
FROM documents""")
def _(load):
    tail = F.expr("CASE doc_id % 9 WHEN 0 THEN X'C328' WHEN 1 THEN X'EFBFBD' WHEN 2 THEN X'00' ELSE X'' END")
    raw = load("documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), tail).alias("raw"))
    return raw.select("doc_id", policy.text_problem("raw").alias("problem"))


@query("path_policy", """
SELECT p_partkey, p_partkey % 5 = 0 AS private, p_partkey % 3 = 0 AS media FROM part""")
def _(load):
    paths = load("part").select("p_partkey", F.expr(r"""concat(CASE WHEN p_partkey % 5 = 0 THEN 'src\\api\\' ELSE 'src/' END,
        CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.WebM' ELSE '.py' END)""").alias("path"))
    broken = policy.path_problems("path")
    return paths.select("p_partkey", F.array_contains(broken, "private client path").alias("private"),
                        F.array_contains(broken, "media or subtitle file").alias("media"))


def _duck_rules() -> str:
    def hit(scope: str, name: str, pattern: str) -> str:
        flag = "'i'" if pattern.startswith("(?i)") else "'c'"
        return (f"SELECT doc_id, path, '{name}' AS rule FROM f WHERE {scope} AND "
                f"regexp_matches(text, '{pattern.removeprefix('(?i)')}', {flag})")

    code, doc = "code", "doc"
    rows = [hit(f"{code} AND NOT connector" if n in policy.CONNECTOR_EXEMPT else code, n, p) for n, p in policy.CODE_RULES.items()]
    rows.append(hit(f"{code} AND connector", *policy.CONNECTOR_RULE))
    rows += [hit(doc, n, p) for n, p in policy.DOC_RULES.items()]
    return ("f AS (SELECT *, (path LIKE 'scripts/%' OR path LIKE 'worker/%') AND regexp_matches(path, '[.](py|yml|yaml|sh)$') AS code, "
            "path LIKE 'docs/%' AND path LIKE '%.md' AS doc, path LIKE '%worker/connector.py' AS connector FROM $files), "
            "hits AS (" + " UNION ALL ".join(rows) + ")")


def hits(load):
    return policy.rule_scan(load("files"), code_prefixes=("scripts/", "worker/"), doc_prefixes=("docs/",),
                            connectors=("worker/connector.py",))


@query("rule_scan", f"WITH {_duck_rules()} SELECT * FROM hits")
def _(load):
    return hits(load)


# A rule per nation, as a table: one of its first letters, some letters and an ending.
@query("rule_table_scan", """
SELECT doc_id, source AS path, n_name AS rule FROM documents JOIN nation ON regexp_matches(text, lower(substr(n_name, 1, 3)) || '[a-z]+' || lower(substr(n_name, 1, 1)))
WHERE n_nationkey % 5 <> 4 OR NOT suffix(source, '9')""")
def _(load):
    start, first = F.lower(F.substring("n_name", 1, 3)), F.lower(F.substring("n_name", 1, 1))
    rules = load("nation").select(F.col("n_name").alias("name"), F.concat(start, F.lit("[a-z]+"), first).alias("pattern"),
                                  F.when(F.col("n_nationkey") % 3 != 0, F.array(start)).alias("factors"),
                                  F.when(F.col("n_nationkey") % 5 == 4, F.array(F.lit("9"))).alias("exempt"))
    return policy.scan_rules(load("documents").select("doc_id", F.col("source").alias("path"), "text"), rules)


@query("violation_report", f"""
WITH {_duck_rules()} SELECT string_split(path, '/')[1] AS folder, rule, count(*) AS violations FROM hits GROUP BY ALL""")
def _(load):
    folder = F.substring_index("path", "/", 1)
    return policy.violation_report(hits(load).withColumn("folder", folder), ["folder"])


# Every document has the same links, so their targets can be stated directly.
@query("dangling_links", """
WITH d AS (SELECT doc_id AS n, CASE WHEN doc_id % 3 = 0 THEN 'docs/deep' ELSE 'docs' END AS folder FROM documents),
p AS (SELECT folder || '/d' || CAST(n AS VARCHAR) || '.md' AS path, * FROM d),
l AS (
  SELECT path, 'd' || CAST(n + 1 AS VARCHAR) || '.md#x' AS target, folder || '/d' || CAST(n + 1 AS VARCHAR) || '.md' AS resolved FROM p
  UNION ALL SELECT path, '../docs/d' || CAST(n - 1 AS VARCHAR) || '.md',
    CASE WHEN folder = 'docs' THEN '' ELSE 'docs/' END || 'docs/d' || CAST(n - 1 AS VARCHAR) || '.md' FROM p
  UNION ALL SELECT path, 'deep', folder || '/deep' FROM p
  UNION ALL SELECT path, 'd%31%30.md', folder || '/d10.md' FROM p
  UNION ALL SELECT path, 'a+b.md', folder || '/a+b.md' FROM p)
SELECT path, target, 'missing' AS problem FROM l
WHERE resolved <> 'docs/deep' AND NOT EXISTS (SELECT 1 FROM p e WHERE e.path = l.resolved)
UNION ALL SELECT path, '../../../out.md', 'escapes' FROM p""")
def _(load):
    docs = load("markdown")
    return policy.dangling_links(docs, docs.select("path"))


@query("manifest_entry_valid", """
SELECT release_id, ord, CASE WHEN path LIKE '/%' OR path LIKE '../%' OR path = 'src/7' THEN 'path'
  WHEN mode NOT IN ('100644', '100755') THEN 'mode' WHEN size IS NULL THEN 'size' WHEN sha256 = 'zz' THEN 'sha256' ELSE 'ok' END AS reason
FROM $manifest""")
def _(load):
    return load("manifest").select("release_id", "ord", integrity.entry_reason(("src/7",)).alias("reason"))


@query("manifest_order", """
SELECT release_id, ord, path, coalesce(lag(path) OVER (PARTITION BY release_id ORDER BY ord) > path, false) AS out_of_order,
       count(*) OVER (PARTITION BY release_id, path) > 1 AS duplicate FROM $manifest""")
def _(load):
    return integrity.manifest_order(load("manifest").select("release_id", "ord", "path"), ["release_id"])


@query("manifest_diff", """
SELECT coalesce(e.release_id, a.release_id) AS release_id, coalesce(e.path, a.path) AS path,
       CASE WHEN e.path IS NULL THEN 'unknown' WHEN a.path IS NULL THEN 'missing'
            WHEN e.size IS DISTINCT FROM a.size OR e.sha256 IS DISTINCT FROM a.sha256 THEN 'digest_mismatch' ELSE 'ok' END AS status
FROM $expected_files e FULL JOIN $actual_files a ON a.release_id = e.release_id AND a.path = e.path""")
def _(load):
    return integrity.manifest_diff(load("expected_files"), load("actual_files"), ["release_id"])


@query("missing_files", """
SELECT release_id, path FROM $expected_files EXCEPT SELECT release_id, path FROM $actual_files""")
def _(load):
    return integrity.missing_files(load("expected_files"), load("actual_files"), ["release_id"])


@query("revocation_check", """
SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 4 THEN 'worker_manifest_invalid'
       WHEN s_nationkey % 5 = 3 OR s_suppkey % 7 = 0 THEN 'worker_signing_key_revoked' ELSE 'ok' END AS status FROM supplier""")
def _(load):
    manifests = load("supplier").select("s_suppkey", (F.col("s_nationkey")).alias("key_id"),
                                        F.sha2(F.col("s_suppkey").cast("string"), 256).alias("digest"))
    keys = load("nation").select(
        F.expr("CASE WHEN n_nationkey % 5 = 4 THEN -n_nationkey ELSE n_nationkey END").alias("key_id"),
        F.expr("element_at(array('active', 'retired', 'active', 'revoked', 'active'), CAST(n_nationkey % 5 + 1 AS INT))").alias("status"))
    listed = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey"))
    revoked = load("supplier").select(F.upper(F.sha2(listed.cast("string"), 256)).alias("digest"))
    return integrity.revocation_check(manifests, keys, revoked).select("s_suppkey", "status")


@query("shared_versions", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '2' END AS versions FROM orders""")
def _(load):
    offered = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("3"), F.lit("2")))
    return load("orders").select("o_orderkey", offered.alias("v")).select(
        "o_orderkey", F.concat_ws(",", integrity.shared_versions("v")).alias("versions"))


@query("tree_digest", """
SELECT release_id, sha256('[' || string_agg(to_json({'mode': mode, 'path': path, 'sha256': sha256, 'size': size})::VARCHAR, ',' ORDER BY ord) || ']') AS tree_sha256
FROM $manifest GROUP BY release_id""")
def _(load):
    return integrity.tree_digest(load("manifest"), ["release_id"])


@query("tree_digest_levels", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY release_id) AS c FROM $manifest),
e AS (SELECT release_id, i // 100 AS part, i, CASE WHEN i = 0 THEN '[' ELSE ',' END
        || to_json({'mode': mode, 'path': path, 'sha256': sha256, 'size': size})::VARCHAR AS piece FROM n
      UNION ALL SELECT DISTINCT release_id, c // 100, c, ']' FROM n),
p AS (SELECT release_id, part, sha256(string_agg(piece, '' ORDER BY i)) AS digest FROM e GROUP BY ALL)
SELECT release_id, sha256(string_agg(digest, '' ORDER BY part)) AS tree_sha256 FROM p GROUP BY release_id""")
def _(load):
    return integrity.tree_digest_levels(load("manifest"), ["release_id"], per_part=100)


# The table files themselves, hashed.
@query("file_inventory", None)
def _(load):
    return file_source.file_inventory(load.spark, load.folder, "*.parquet")
