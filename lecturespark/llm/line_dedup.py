"""Line dedup: lines that many documents share stay in one document only.

Main path: DataFrame functions alone. Line hashes are range-partitioned with a
secondary sort by document (largest first) and position, the first occurrence in each
document is streamed out, and the result is one compressed bitmap per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import BLANKS, LOWER, UPPER, ascii_lower, stored

MIN_CHARS, MIN_DOCS = 40, 5


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, n_dropped, keep): which lines of a document stay.

    ``keep`` holds (word, bits) for every 64-line word in which a line goes; bit ``i`` of
    ``bits`` is 1 if line ``64 * word + i`` stays. Words that are absent are all ones, and
    documents without a row keep every line. Ties cannot arise: a line stays in the
    largest id. Rows with one id count as one document; the text hash tells apart rows
    that share an id but not a text. A null id is one document below all others. Null
    and empty texts have one empty line, which is too short to go.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    lines = stored(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "id", "text_hash", "pos"))
    # A very common line spans many ranges, because the document is part of the range key.
    ranged = lines.repartitionByRange("h1", "h2", F.col("id").desc())
    first = Window.partitionBy("h1", "h2", "id").orderBy("pos", "text_hash")
    firsts = ranged.withColumn("n", F.row_number().over(first)).filter("n = 1")
    keys = stored(firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
                  .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))
    gone = lines.join(keys, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    words = (gone.groupBy("id", "text_hash", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone")))
    return words.groupBy("id", "text_hash").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")).withColumnRenamed("id", id_col)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text`` added; rows and columns stay."""
    marks = bitmaps.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_gone"),
                           F.map_from_entries("keep").alias("_keep"))
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    joined = docs.join(marks, same, "left")

    def stays(_, at):
        bits = F.coalesce(F.try_element_at("_keep", F.shiftright(at, 6)), F.lit(-1).cast("long"))
        return bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))) != 0

    text = F.coalesce(docs[text_col], F.lit(""))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.filter(text_lines(text), stays), "\n"))
    added = {"n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
             "n_dropped": F.coalesce("_gone", F.lit(0)).cast("long"), "kept_text": kept}
    return joined.select(*[docs[c] for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


@query("op1_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
