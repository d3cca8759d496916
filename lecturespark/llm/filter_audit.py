"""Filter interaction audit: what every filter removes in every order of the filters.

Each document is one of 32 masks of the filters that it fails. A mask cell folds across
the array of all orders with ``transform`` and ``aggregate`` into one weighted struct a
step, 600 in all, and the cells of a part merge by elementwise sums. The corpus is read
once; the orders only ever meet cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import WORD

LETTERS = "ABCDE"
BITS = {letter: 1 << at for at, letter in enumerate(LETTERS)}
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails by itself, as bits."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fails = {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }
    return sum((fails[k].cast("int") * BITS[k] for k in fails), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, at most 32 rows a part.

    Filter E fails where a row of smaller id has the same text. Only digests of texts are
    shuffled; rows are counted by digest and id first, so that a text that a third of all
    rows share is a few counts in each task. Rows with one id fail E alike; a null id is
    neither smaller nor larger than any other, so its rows pass E. A null text is empty, a
    null part the empty string. A document is good or toxic if any label of its id says so;
    labels without an id belong to none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    marked = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ("digest", "part", "own", "good", "toxic")
    of_ids = marked.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    kinds = of_ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
                                      least.alias("least"))
    # One digest has at most four kinds a part by now.
    first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(first, F.col("least.n")).otherwise(0)
    split = kinds.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("own") + BITS["E"]).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("c"))
    return split.filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _weight(mask: Column, bit: Column, seen: Column) -> Column:
    """What a cell adds to the step that applies the filter ``bit`` after the filters ``seen``."""
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(seen) != 0
    when = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit,
            "good_lost": fails & ~gone, "toxic_lost": fails & ~gone}
    weight = {"good_lost": "good", "toxic_lost": "toxic"}
    return F.struct(*[F.when(when[c], F.col(weight.get(c, "n"))).otherwise(F.lit(0).cast("long")).alias(c) for c in COUNTS])


def audit(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts, shapley): 600 rows for every part of ``mask_cells``; none for an empty table.

    ``shapley`` is what the step's filter removes, summed over all orders at any step.
    """
    orders = F.lit([[BITS[x] for x in order] for order in ORDERS])
    nothing = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>").alias("out"))

    def step(state: Column, bit: Column) -> Column:
        here = _weight(F.col("mask"), bit, state["seen"])
        return F.struct(state["seen"].bitwiseOR(bit).alias("seen"), F.concat(state["out"], F.array(here)).alias("out"))

    folded = cells.withColumn("steps", F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["out"]))))
    # At most 32 cells a part, of 600 structs each.
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("all")).select("part", F.aggregate(
        "all", F.array_repeat(nothing, len(ORDERS) * len(LETTERS)), lambda total, one: F.zip_with(total, one, add)).alias("steps"))
    rows = merged.select("part", F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.lit(ORDERS), (F.col("at") / len(LETTERS)).cast("int") + 1)
    rows = rows.select("part", order.alias("filter_order"), (F.col("at") % len(LETTERS) + 1).alias("step"), "s.*")
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.withColumn("shapley", F.sum("removed").over(of_filter))


@query("op13_filter_audit", """
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
masks AS (
  SELECT part, good, toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(words.t, '[A-Z]')) > 10 * length(words.t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts ON words.t = firsts.t),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS seen FROM orders, range(1, 6) AS r(s)),
counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (seen | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & seen <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & seen = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted""")
def filter_audit_query(spark: SparkSession, folder: str) -> DataFrame:
    return audit(mask_cells(table(spark, folder, "documents"), table(spark, folder, "labels")))
