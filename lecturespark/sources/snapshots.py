"""Stored state snapshots: which one counts and which may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(snapshots: DataFrame, prefix: str) -> DataFrame:
    return snapshots.where(F.startswith("name", F.lit(prefix)) & ~F.coalesce("expired", F.lit(False)))


def latest(snapshots: DataFrame, keys: list[str], prefix: str, order: list[str]) -> DataFrame:
    """The newest usable snapshot of each key and how many older ones there are."""
    return usable(snapshots, prefix).groupBy(*keys).agg(
        F.max_by("name", F.struct(*order)).alias("latest"), (F.count(F.lit(1)) - 1).alias("to_delete"))


def superseded(snapshots: DataFrame, keys: list[str], prefix: str, order: list[str]) -> DataFrame:
    """All usable snapshots but the newest: one maximum per key, joined back."""
    rows = usable(snapshots, prefix)
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_newest"))
    return rows.join(newest, keys).where(F.struct(*order) < F.col("_newest")).drop("_newest")
