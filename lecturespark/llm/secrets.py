"""Secret scans: spans of credentials, told from examples by who owns them across the corpus.

Main path: DataFrame functions alone. Three patterns give the base spans of a text. A
fourth finds tokens that look like credentials without a keyword beside them. The hashes
of all these values are counted over the whole corpus by distinct repository and owner:
a value that many owners hold is a copied example, one that stays with an owner is live.
Live tokens become spans too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .shared import stored

KINDS = ("assign", "access", "hex", "live")
KEYWORDS = "password|passwd|secret|token|api_?key"
# Runs of at least the stated length are what longer runs without failing ones leave, so the length stands
# in the pattern; for assignments it is tested afterwards, as a failing match uses up its text.
ASSIGN = rf"""(?i:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ASSIGN_CHARS, MIN_CHARS = 6, 20
MIN_DIFFERENT, MIN_SWITCHES = 10, 4  # of a value that looks drawn at random
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|xxxx"
MOST_OWNERS = 2  # of a value that belongs to somebody
STEP = 256


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For an array of integers, at each place the sum of all earlier ones, a step of ``STEP`` places at a time.

    Appending to one array place by place would take time in the square of its length.
    """
    first = F.array(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def running(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def of(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STEP))
        steps = F.transform(starts, lambda at: F.slice(values, at, STEP))

        def joined(parts: Column) -> Column:
            before = F.aggregate(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), first,
                                 lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
            return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.slice(running(p, b), F.lit(1), F.size(p))))

        return bound(steps, joined)

    return bound(lengths, of)


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, kind, end, value) of each match, leftmost and not overlapping, in code points; ``value`` is the group's text.

    The pieces between the matches and the matches themselves make up the text, so the
    places follow from their lengths. ``pattern`` must not match the empty string.
    """
    none = F.array().cast("array<struct<start:bigint,kind:int,`end`:bigint,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))

        def spans(gap: Column) -> Column:
            before = sums_before(F.zip_with(F.slice(gap, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m)))
            starts = F.zip_with(before, F.slice(gap, F.lit(1), F.size(found)), lambda b, g: b + g)
            value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
            return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), value(m).alias("value")))

        return F.when(F.size(found) == 0, none).otherwise(bound(gaps, spans))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns, by start and then kind."""
    assigned = F.filter(matches(text, ASSIGN, 0, group=1), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    return F.array_sort(F.concat(assigned, matches(text, ACCESS, 1), matches(text, HEX, 2)))


def looks_live(value: Column) -> Column:
    """Long, of many different characters, letters and digits taking turns, and no placeholder."""
    switches = F.regexp_count(value, F.lit("[A-Za-z][0-9]")) + F.regexp_count(value, F.lit("[0-9][A-Za-z]"))
    return ((F.length(value) >= MIN_CHARS) & (switches >= MIN_SWITCHES) & ~F.lower(value).rlike(PLACEHOLDER)
            & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DIFFERENT))


def render(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(values: DataFrame) -> DataFrame:
    """``values`` (h1, h2, repository, owner), any number of rows each: (h1, h2, n_owners, n_repositories).

    Distinct pairs come first, so a value that a third of all rows hold is spread by its
    repositories and then added up from one partial count a task. A null owner or
    repository is one of its own.
    """
    pairs = values.select("h1", "h2", "owner", "repository").distinct()
    owners = pairs.groupBy("h1", "h2", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id",
                 owner_col: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """``docs`` without the text, with ``base`` and ``spans`` (start, kind, end, value), ``n_live`` and ``n_copied``.

    ``kind`` counts into ``KINDS``. ``spans`` holds all of ``base`` and, as kind ``live``, the
    tokens off the base spans that look live and whose value at most ``most_owners`` owners
    hold. ``n_live`` counts the spans whose value looks live and is held so, ``n_copied``
    those whose value more owners hold. A null or empty text has no span. Rows stay, repeated ones
    and those with a null id as well: a row's spans depend on its own text and the corpus
    counts only. Columns with one of the new names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    off = lambda base: lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    added = ("base", "spans", "n_live", "n_copied")
    keep = [c for c in docs.columns if c not in (*added, text_col)]
    kept = F.struct(*[F.col(c) for c in keep])
    scanned = docs.select(kept.alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), F.col(repository_col).cast("string").alias("_repository"),
                          F.col(owner_col).cast("string").alias("_owner"), base_spans(text).alias("base"),
                          F.filter(matches(text, TOKEN, 3), lambda s: looks_live(s["value"])).alias("tokens"))
    off_base = F.when(F.size("tokens") == 0, F.col("tokens")).otherwise(F.filter("tokens", off(F.col("base"))))
    found = stored(scanned.withColumn("tokens", off_base))
    hashed = lambda v: F.struct(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("secret"), v).alias("h2"))
    spans = F.concat("base", "tokens")
    some = found.filter(F.size(spans) > 0)
    values = some.select(F.col("_owner").alias("owner"), F.col("_repository").alias("repository"),
                         F.explode(F.array_distinct(F.transform(spans, lambda s: hashed(s["value"])))).alias("h"))
    owned = stored(ownership(values.select("h.h1", "h.h2", "owner", "repository")))
    every = some.select("_id", "_text", F.explode(spans).alias("s"))
    every = stored(every.select("_id", "_text", "s", looks_live(F.col("s.value")).alias("looks"), hashed(F.col("s.value")).alias("h"))
                   .select("_id", "_text", "s", "looks", "h.h1", "h.h2"))
    # Both sides are scans, so adaptive execution can split a value that very many rows hold.
    judged = every.join(owned, ["h1", "h2"]).withColumn("copied", F.col("n_owners") > most_owners)
    # Repeated rows give equal spans, which a set holds once.
    of_row = judged.groupBy("_id", "_text").agg(F.collect_set(F.struct("s", "looks", "copied")).alias("judged"))
    marks = of_row.select(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"),
                          F.size(F.filter("judged", lambda j: j["looks"] & ~j["copied"])).cast("long").alias("n_live"),
                          F.size(F.filter("judged", lambda j: j["copied"])).cast("long").alias("n_copied"),
                          F.transform(F.filter("judged", lambda j: (j["s"]["kind"] == 3) & ~j["copied"]), lambda j: j["s"]).alias("live"))
    joined = found.join(marks, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    every_span = F.when(F.coalesce(F.size("live"), F.lit(0)) <= 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "live")))
    return joined.select(*[F.col("_row")[c].alias(c) for c in keep], "base", every_span.alias("spans"),
                         *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")])


def _duck_spans(kind: str, number: int, pattern: str, group: int = 0) -> str:
    """Matches of one kind in DuckDB, placed by the lengths of the pieces between them."""
    value = f"regexp_extract(m, '{pattern}', {group})" if group else "m"
    return f"""
  SELECT doc_id, t, source, '{kind}' AS kind, {number} AS k, {value} AS value, at_start AS "start", at_start + length(m) AS "end"
  FROM (SELECT doc_id, t, source, m, CAST(sum(length(g)) OVER upto + coalesce(sum(length(m)) OVER before, 0) AS BIGINT) AS at_start
        FROM (SELECT doc_id, t, source, unnest(found) AS m, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS i
              FROM (SELECT doc_id, t, source, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM texts))
        WINDOW upto AS (PARTITION BY doc_id ORDER BY i), before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_DUCK_ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in KEYWORDS)
_DUCK_ASSIGN = f"""({_DUCK_ASSIGN})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_DUCK_JOINED = """coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", k) {}, '')"""


@query("op12_secret_scan", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
base AS (SELECT * FROM ({_duck_spans('assign', 0, _DUCK_ASSIGN, 2)}) WHERE length(value) >= 6
  UNION ALL {_duck_spans('access', 1, ACCESS)} UNION ALL {_duck_spans('hex', 2, HEX)}),
looking AS (
  SELECT *, length(value) >= 20 AND len(regexp_extract_all(value, '[A-Za-z][0-9]')) + len(regexp_extract_all(value, '[0-9][A-Za-z]')) >= 4
            AND NOT regexp_matches(lower(value), '{PLACEHOLDER}') AND len(list_distinct(string_split(value, ''))) >= 10 AS looks
  FROM (SELECT * FROM base UNION ALL {_duck_spans('live', 3, TOKEN)})),
candidates AS (
  SELECT * FROM looking l WHERE k < 3 OR (looks AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b."start" < l."end" AND l."start" < b."end"))),
owned AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM candidates GROUP BY value),
judged AS (SELECT c.*, n_owners > 2 AS copied FROM candidates c JOIN owned o ON c.value = o.value),
marked AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         {_DUCK_JOINED.format('FILTER (WHERE k < 3)')} AS base, {_DUCK_JOINED.format('FILTER (WHERE k < 3 OR NOT copied)')} AS spans,
         count(*) FILTER (WHERE looks AND NOT copied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied
  FROM judged GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts t LEFT JOIN marked m ON t.doc_id = m.doc_id""")
def secret_scan_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    found = find_secrets(docs)
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"), "n_live", "n_copied")
