"""Mixing sources to target weights, in whole epochs and one exact cut.

Main path: DataFrame functions alone. Documents get hash-random keys; key ranges
inside a source are sorted, ranges carry distributed prefix sums of word counts, and
each source is cut at exactly its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import WORD, running_totals, stored, word_count

SEED, CAP = "mix-1", 3
KEY_BITS, RANGES = 60, 1024


def random_key(id_col: Column, seed: str = SEED) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, size) → (source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared
    again. With the sources in order of cap / weight, the full ones are a prefix.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()], {"rank": "one"})
    ranked = stored(ranked.select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight"), (cap * F.col("source_size")).alias("most")))
    level = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    level = stored(running_totals(level, [F.col("ratio"), F.col("source").asc_nulls_last()], {"most_before": "most", "weight_before": "weight"}))
    # One row: the totals; then one row: the first source that is not full.
    total, weights = level.agg(F.sum("source_size"), F.sum("weight")).first()
    share = f"CAST({total or 0} - most_before AS DOUBLE) / ({weights or 1} - weight_before)"
    open_row = level.filter(f"most > weight * ({share})").orderBy("ratio", F.col("source").asc_nulls_last()).selectExpr(f"{share} AS share").first()
    rate = open_row[0] if open_row else float("inf")
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(rate)) if open_row else F.col("most").cast("double")
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: str = SEED, cap: int = CAP, ranges: int = RANGES) -> DataFrame:
    """Per document: id, text_hash, size, source_size, target, epochs, last_words, taken.

    A document goes in ``epochs`` times whole and once more with its first ``last_words``
    words. Documents come in the order of a hash of id and seed, ties by id and size, so
    reruns agree; equal rows are interchangeable. A null source is a source of its own,
    null and empty texts have size 0 and take 0, and a null id hashes like an empty one.
    ``ranges`` key ranges per source bound what one task sorts.
    """
    sizes = stored(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
        .withColumn("range", F.shiftright("key", KEY_BITS - (ranges.bit_length() - 1)).cast("int"))
        .withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    targets = source_targets(sizes, cap).withColumn("group", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sizes.groupBy("group", "range").agg(F.sum("size").alias("words"))
             .select("group", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")).join(targets, "group"))
    inside = Window.partitionBy("group", "range").orderBy("key", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sizes.repartitionByRange("group", "range")
              .withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["group", "range"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    placed = placed.withColumn("epochs", epochs).withColumn("last_words", F.greatest(F.lit(0), F.least("size", rest)).cast("long"))
    return placed.select(F.col("id").alias(id_col), "text_hash", "size", "source_size", "target", "epochs", "last_words",
                         (F.col("epochs") * F.col("size") + F.col("last_words")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n), "")


def apply_mix(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str | None = None) -> DataFrame:
    """The mixed corpus: each document once per whole epoch, then its cut copy; ``copy`` counts from 0.

    Rows that share an id and a text are taken alike, by the amounts of all of them. A column
    ``copy`` of the documents is replaced. A column named ``mark`` is true where a text is only
    the first part of its document's.
    """
    marks = mix.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.min("epochs").alias("_epochs"), F.max("last_words").alias("_last"), F.max("size").alias("_size"))
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    joined = docs.join(marks, same)
    copies = joined.withColumn("copy", F.explode(F.expr("sequence(0L, _epochs)"))).filter("copy < _epochs OR _last > 0")
    cut = (F.col("copy") == F.col("_epochs")) & (F.col("_last") < F.col("_size"))
    text = F.when(cut, first_words(F.col(text_col), F.col("_last").cast("int"))).otherwise(F.col(text_col)).alias(text_col)
    kept = [text if c == text_col else F.col(c) for c in docs.columns if c not in ("copy", mark)]
    return copies.select(*kept, "copy", *([cut.alias(mark)] if mark else []))


@query("op2_mix_sources", rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
level AS (
  SELECT *, {CAP} * source_size AS most,
         coalesce(sum({CAP} * source_size) OVER earlier, 0) AS most_before, coalesce(sum(weight) OVER earlier, 0) AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM sources WINDOW earlier AS (ORDER BY {CAP} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT min_by(share, most / weight) AS rate
  FROM (SELECT *, CAST(total - most_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) AS share FROM level) WHERE most > weight * share),
targets AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * rate) AS target FROM level, rate),
placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed""")
def mix_query(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
