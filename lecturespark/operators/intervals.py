"""Joining points with the closed intervals that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINEST_LEVEL = 14


def join_points_to_intervals(points: DataFrame, intervals: DataFrame, keys: list[str],
                             at: str, lower: str, upper: str) -> DataFrame:
    """Inner join where ``lower <= at <= upper``, both ends included.

    An interval goes to the power-of-two grid whose cells are longer than itself,
    so it touches at most two cells; a point is looked up once per grid its key
    uses. The join is on (key, grid, cell), never on the key alone, so a key with
    a third of all rows spreads over many cells. No interval length or count is
    assumed.
    """
    level = F.greatest(F.length(F.bin(F.col(upper) - F.col(lower))), F.lit(FINEST_LEVEL))
    cells = (
        intervals.where(F.col(lower) <= F.col(upper))
        .withColumn("_level", level)
        .withColumn("_first", F.expr(f"shiftright({lower}, _level)"))
        .withColumn("_cell", F.explode(F.sequence("_first", F.expr(f"shiftright({upper}, _level)"))))
        .drop("_first")
    )
    # At most 63 levels exist, so the set per key is small whatever the key's size.
    levels = (intervals.where(F.col(lower) <= F.col(upper)).select(*keys, level.alias("_level"))
              .groupBy(*keys).agg(F.collect_set("_level").alias("_levels")))
    looked_up = (
        points.join(levels, keys)
        .withColumn("_level", F.explode("_levels")).drop("_levels")
        .withColumn("_cell", F.expr(f"shiftright({at}, _level)"))
    )
    return (
        looked_up.join(cells, [*keys, "_level", "_cell"])
        .where(F.col(at).between(F.col(lower), F.col(upper)))
        .drop("_level", "_cell")
    )
