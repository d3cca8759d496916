"""Chains along ordered groups of any size: who follows whom, and which rows a walk from the first one meets.

A group is cut by position into blocks of ``FAN`` rows, blocks into blocks of blocks, and
so on. "The first later row with at least this value" is looked up in the row's own block,
then in ever larger ones beside it, then down again. A walk is followed by doubling: in
every round each row knows the row twice as many steps ahead. All joins are on group and
position, so one group spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FAN = 64
NEVER = -(2 ** 63)


def _first_hit(values: Column, least: Column) -> Column:
    """The place of the first value that reaches ``least``, from 1; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(values, lambda v: v >= least), True), F.lit(0)).cast("bigint")


def first_at_least(rows: DataFrame, keys: list[str], value: str, least: str) -> DataFrame:
    """(keys, pos, next): for each row the position of the first later row of its group whose ``value`` reaches its ``least``.

    ``pos`` counts from 0 without gaps inside a group. Rows without such a row are left out;
    a null value reaches nothing, and a null ``least`` asks for nothing.
    """
    parent = lambda column: F.floor(F.col(column) / FAN).cast("bigint")
    narrow = rows.select(*keys, "pos", F.coalesce(F.col(value), F.lit(NEVER)).alias("v"), F.col(least).alias("t"))
    blocks = narrow.groupBy(*keys, parent("pos").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "v", "t"))).alias("r"))
    blocks = materialise(blocks.withColumn("values", F.transform("r", lambda x: x["v"])))
    own = blocks.select(*keys, "block", F.explode(F.transform("r", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["t"].alias("t"), _first_hit(F.slice("values", i + 2, F.lit(FAN)), x["t"]).alias("hit")))).alias("x"))
    own = materialise(own.select(*keys, "x.*", F.col("block").alias("at")).where("t IS NOT NULL"))
    answers = [own.where("hit > 0").select(*keys, "pos", (F.col("pos") + F.col("hit")).alias("next"))]
    # levels[k]: each block of level k with the greatest values of its parts.
    levels, found = [blocks.select(*keys, F.col("block").alias("up"), "values")], []
    rest = own.where("hit = 0").select(*keys, "pos", "t", "at")
    while levels[-1].where("up > 0").limit(1).count():
        parts = levels[-1].select(*keys, F.col("up").alias("part"), F.array_max("values").alias("v"))
        grouped = parts.groupBy(*keys, parent("part").alias("up")).agg(F.array_sort(F.collect_list(F.struct("part", "v"))).alias("p"))
        levels.append(materialise(grouped.select(*keys, "up", F.transform("p", lambda x: x["v"]).alias("values"))))
        asked = rest.withColumn("up", parent("at")).join(levels[-1], [*keys, "up"])
        later = F.slice("values", (F.col("at") % FAN + 2).cast("int"), F.lit(FAN))
        asked = materialise(asked.withColumn("hit", _first_hit(later, F.col("t"))).drop("values"))
        found.append(asked.where("hit > 0").select(*keys, "pos", "t", (F.col("at") + F.col("hit")).alias("up")))
        rest = asked.where("hit = 0").select(*keys, "pos", "t", F.col("up").alias("at"))
    # Down again: the part that was found has the row, its own parts tell where.
    below = None
    for level in range(len(found) - 1, -1, -1):
        here = found[level] if below is None else found[level].unionByName(below)
        inside = here.join(levels[level], [*keys, "up"])
        below = materialise(inside.select(*keys, "pos", "t", (F.col("up") * FAN + _first_hit(F.col("values"), F.col("t")) - 1).alias("up")))
    if below is not None:
        answers.append(below.select(*keys, "pos", F.col("up").alias("next")))
    return reduce(DataFrame.unionByName, answers)


def walked(steps: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos) of every row that a walk from ``starts`` along ``steps`` (keys, pos, next) meets, the starts included."""
    met, ahead = starts.select(*keys, "pos"), materialise(steps.select(*keys, "pos", "next"))
    while True:
        new = materialise(met.join(ahead, [*keys, "pos"]).select(*keys, F.col("next").alias("pos")))
        if new.isEmpty():
            return met
        met = materialise(met.unionByName(new))
        further = ahead.select(*keys, F.col("pos").alias("next"), F.col("next").alias("far"))
        ahead = materialise(ahead.join(further, [*keys, "next"]).select(*keys, "pos", F.col("far").alias("next")))
