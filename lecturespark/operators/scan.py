"""Running totals over ordered groups whose size has no bound.

A plain window over one key sends the whole key to one task. That is the best
plan while every key is small, and it fails when one key holds a third of the
table. ``OrderedRows`` measures the keys first (a column-pruned count) and treats

* small keys directly: one shuffle on the key, windows over the key;
* large keys in blocks: their rows alone are range-partitioned by (key, order),
  so a large key is cut into many blocks of about equal size; windows run inside
  a block, and the totals of the earlier blocks of the same key are added from a
  carry table. Every range boundary cuts at most one key, so the carry table has
  at most two rows per partition and its broadcast is bounded by the partition
  count, not by the data. The list of large keys is bounded too: there are at most
  rows / ``ROWS_PER_TASK`` of them.

Sums and maxima are associative, so both plans give the same values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

ROWS_PER_TASK = 1_000_000
BLOCK = "_block"


def rows_of_large_keys(df: DataFrame, keys: list[str], limit: int) -> int:
    """Rows of the keys with more than ``limit`` rows; counts combine before the shuffle."""
    large = df.groupBy(*keys).count().agg(F.sum(F.when(F.col("count") > limit, F.col("count"))).alias("n")).first()
    return int(large["n"] or 0)


def large_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The keys with more than ``limit`` rows, stored: they are few and used often."""
    counted = df.groupBy(*keys).count()
    return materialise(counted.where(F.col("count") > limit).select(*[F.col(k).alias(f"_large_{k}") for k in keys]))


def range_blocks(df: DataFrame, keys: list[str], order: list[str], rows: int, rows_per_task: int) -> DataFrame:
    """Cut ``rows`` rows, ordered by (key, order), into blocks of about ``rows_per_task`` rows."""
    ranged = df.repartitionByRange(max(1, -(-rows // rows_per_task)), *keys, *order)
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _of_keys(df: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Rows whose key is listed (left_semi) or not (left_anti); null keys count as keys."""
    on = [F.col(c.removeprefix("_large_")).eqNullSafe(F.col(c)) for c in listed.columns]
    return df.join(F.broadcast(listed), on, how)


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum or max; exclusive leaves the row itself out."""

    kind: str
    value: Column
    exclusive: bool = False


class OrderedRows:
    """Rows with running values.

    ``sized_by`` may name a cheaper table with the same keys and at least as many
    rows per key to measure instead of ``df``. ``blocked=False`` says that all keys are
    small, and ``like`` takes the large keys of rows measured before.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], *, rows_per_task: int | None = None,
                 blocked: bool | None = None, sized_by: DataFrame | None = None, like: OrderedRows | None = None):
        self.keys, self.order = list(keys), list(order)
        self.large: DataFrame | None = None
        limit, rows = rows_per_task or ROWS_PER_TASK, 0
        if like is not None:
            self.large, limit, rows = like.large, like.limit, like.rows
        elif blocked is not False:
            measured = df if sized_by is None else sized_by
            rows = rows_of_large_keys(measured, self.keys, limit)
            if rows:
                self.large = large_keys(measured, self.keys, limit)
        self.df, self.limit, self.rows = df, limit, rows
        if self.large is not None:
            small = _of_keys(df, self.large, "left_anti").withColumn(BLOCK, F.lit(-1))
            self.df = small.unionByName(range_blocks(
                _of_keys(df, self.large, "left_semi"), self.keys, self.order, rows, limit))

    @property
    def blocked(self) -> bool:
        return self.large is not None

    def _with(self, df: DataFrame) -> OrderedRows:
        clone = object.__new__(OrderedRows)
        clone.keys, clone.order, clone.large, clone.df = self.keys, self.order, self.large, df
        clone.limit, clone.rows = self.limit, self.rows
        return clone

    def derive(self, **columns: Column) -> OrderedRows:
        return self._with(self.df.withColumns(columns))

    def running(self, **outputs: Running) -> OrderedRows:
        combine = {"sum": F.sum, "max": F.max}
        group = self.keys + ([BLOCK] if self.blocked else [])
        window = Window.partitionBy(*group).orderBy(*self.order)
        local = self.df.withColumns({
            name: combine[spec.kind](spec.value).over(
                window.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else 0))
            for name, spec in outputs.items()
        })
        if self.blocked:
            local = self._add_carry(local, combine, outputs)
        zero = {name: F.coalesce(F.col(name), F.lit(0)) for name, s in outputs.items() if s.kind == "sum"}
        return self._with(local.withColumns(zero) if zero else local)

    def _add_carry(self, local: DataFrame, combine: dict, outputs: dict[str, Running]) -> DataFrame:
        # Small keys have block -1; the condition leaves their rows out of this pass.
        totals = self.df.where(F.col(BLOCK) >= 0).groupBy(*self.keys, BLOCK).agg(
            *[combine[spec.kind](spec.value).alias(f"_t_{name}") for name, spec in outputs.items()])
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            totals.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
            .where("_blocks > 1")
            .select(*self.keys, BLOCK, *[combine[spec.kind](f"_t_{name}").over(earlier).alias(f"_c_{name}")
                                         for name, spec in outputs.items()])
        )
        on = [local[k].eqNullSafe(carry[k]) for k in self.keys + [BLOCK]]
        joined = local.join(F.broadcast(carry), on, "left").select(
            *[local[c] for c in local.columns if c not in outputs],
            *[(F.coalesce(local[name], F.lit(0)) + F.coalesce(carry[f"_c_{name}"], F.lit(0))
               if spec.kind == "sum" else F.greatest(local[name], carry[f"_c_{name}"])).alias(name)
              for name, spec in outputs.items()],
        )
        return joined

    def result(self) -> DataFrame:
        return self.df.drop(BLOCK)


def list_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "idx",
                   **options) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … in the given order."""
    rows = OrderedRows(df, keys, order, **options)
    rows = rows.running(**{name: Running("sum", F.lit(1).cast("bigint"), exclusive=True)})
    return rows.result()


def document_parts(pieces: DataFrame, keys: list[str], ord_col: str, piece: str,
                   per_part: int, name: str = "text") -> DataFrame:
    """Join pieces into texts in order, at most ``per_part`` positions to a row.

    ``ord_col`` counts from 0 without gaps within a key (extra pieces may share a
    part with a negative order). The parts of a key, concatenated by ``part``,
    are the whole text, so a text of any length never has to fit into one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(piece).alias("p"))))
    part = F.floor(F.greatest(F.col(ord_col), F.lit(0)) / per_part).cast("bigint")
    return (
        pieces.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.concat_ws("", F.transform(ordered, lambda x: x["p"])).alias(name))
    )
