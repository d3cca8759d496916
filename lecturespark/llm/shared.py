"""What several operators share: stored tables, word columns, running totals, components."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Space and U+0009 to U+000D; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    Cuts the lineage so that lost executors cost one read, and keeps a costly scan
    from running again for every use. The tables live below ``llm/`` in the folder
    that ``spark.checkpoint.dir`` names and go with that folder.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters untouched."""
    # lower() changes A-Z alone where every character is one byte, and is much faster there.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: list, totals: dict[str, str]) -> DataFrame:
    """``totals`` {new column: value column}: the sum over all earlier rows in ``order``.

    Rows are sorted by ranges; each range adds the totals of the ranges before it. Only
    one row per range is ever gathered. ``order`` must be a total order.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in totals])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(sums, "_range").select(
        *df.columns, *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_before_{k}")).alias(k) for k, v in totals.items()])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): each linked node with the smallest node it reaches: (node, component).

    Every round moves a node to the smallest node next to it, follows that move once more,
    and contracts the links, so that a round's work shrinks with the links that are still
    open. Labels and links stay distributed; the driver sees one test for emptiness per round.
    """
    ordered = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, classes = stored(ordered.distinct()), None
    while True:
        lowest = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        moves = ends.join(lowest, "node", "left").withColumn("low", F.coalesce("low", "node"))
        far = lowest.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        moves = stored(moves.join(far, "low", "left").select("node", F.coalesce("lower", "low").alias("to")))
        if classes is None:
            classes = moves.withColumnRenamed("to", "component")
        else:
            step = moves.select(F.col("node").alias("component"), "to")
            classes = stored(classes.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        contracted = (links.join(moves.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
                      .join(moves.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b").filter("to_a <> to_b"))
        links = stored(contracted.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if links.isEmpty():
            return classes
