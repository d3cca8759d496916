"""MinHash near-dedup on SetSketch registers.

A register is the smallest of one exponential value per shingle, truncated to a power of
``BASE``: registers merge by maximum and agree on two sets with a probability of at
least the sets' Jaccard similarity. Bands of registers give candidates, the joint
likelihood of two register vectors drops chance ones, and full sets verify the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .shared import components, stored
from .words import SHINGLE, mixed, runs, shingle_sets, slices

# By theory 48 bands of 4 registers miss a pair at similarity 0.75 once in 10^8 cases.
BANDS, ROWS = 48, 4
REGISTERS, BASE, SHIFT, TOP = BANDS * ROWS, 1.001, 36_000, 65_535
SIMILAR = 0.75
# Odds of e^14 against the threshold drop a candidate: about five standard deviations.
MARGIN = 14.0
BLOCK = 512


def sketch(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Registers (sets x REGISTERS, uint16) of sets given as 64-bit hashes.

    An element visits all registers in an order of its own with rising values, and stops
    as soon as its value exceeds every minimum of its set.
    """
    n_sets, m = len(offsets) - 1, REGISTERS
    least = np.full(n_sets * m, np.inf)
    rows = np.repeat(np.arange(n_sets), np.diff(offsets))
    seed = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
    at = (seed % np.uint64(m)).astype(np.int64)
    # Steps without a factor in common with m visit every register once.
    steps = np.array([s for s in range(1, m) if np.gcd(s, m) == 1])
    step = steps[(mixed(seed) % np.uint64(len(steps))).astype(np.int64)]
    state, value = hashes, np.zeros(len(hashes))
    for j in range(m):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        value = value - np.log(uniform) / (m - j)
        np.minimum.at(least, rows * m + at, value)
        worst = least.reshape(n_sets, m).max(axis=1) if n_sets else least
        live = value < worst[rows]
        if not live.any():
            break
        if live.sum() < len(live):
            rows, at, step, state, value = rows[live], at[live], step[live], state[live], value[live]
        at = (at + step) % m
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE)) + SHIFT / 2
    return np.clip(level, 0, TOP).astype(np.uint16).reshape(n_sets, m)


def likely(n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray, similar: float, margin: float = MARGIN) -> np.ndarray:
    """Whether a similarity of ``similar`` or more is possible for sizes n_a, n_b and counts of greater and lesser registers.

    The joint likelihood of the register comparisons is taken over a grid of similarities.
    """
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    highest = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.concatenate([np.linspace(0, similar, 40), np.linspace(similar, 1, 20)])
    j = np.minimum(grid[None, :], highest[:, None])

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up = chance(share_a[:, None] - share_b[:, None] * j)
    down = chance(share_b[:, None] - share_a[:, None] * j)
    tiny = 1e-12
    score = (greater[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny))
             + (REGISTERS - greater - less)[:, None] * np.log(np.maximum(1 - up - down, tiny)))
    return (highest >= similar) & (score[:, 40:].max(axis=1) >= score[:, :40].max(axis=1) - margin)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, print, sketch) per row; ``print`` is equal for equal sets; empty sets have nulls."""

    def made(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in slices(whole, 1):
                offsets, hashes = shingle_sets(batch.column(1), size)
                registers = sketch(offsets, hashes)
                n = np.diff(offsets)
                prints = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets, offsets[1:])]
                rows = [r.tobytes() if k else None for r, k in zip(registers, n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.binary())],
                    ["id", "n_shingles", "print", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(made, "id long, n_shingles long, print binary, sketch binary")


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely_pairs(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def kept(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = _registers(batch.column("sketch_a")), _registers(batch.column("sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            good = likely(n_a, n_b, (a > b).sum(axis=1), (a < b).sum(axis=1), similar)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(kept, "a long, b long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _linked(x: np.ndarray, y: np.ndarray, hundredths: int) -> bool:
    """Whether the similarity of two full sets is at least ``hundredths`` of 1."""
    both = _shared(x, y)
    return both > 0 and 100 * both >= hundredths * (len(x) + len(y) - both)


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, hashes): the sorted shingles of the documents that are candidates at all."""

    def made(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                offsets, hashes = shingle_sets(batch.column(1), size)
                sets = [hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The ids grow with the documents, so they are never broadcast.
    return texts.join(ids.hint("merge"), "id", "left_semi").select("id", "text").mapInArrow(made, "id long, hashes binary")


def _verified(pairs: DataFrame, full: DataFrame, similar: float) -> DataFrame:
    """The pairs whose full shingle sets have at least the similarity."""
    hundredths = round(100 * similar)

    def kept(batches):
        for batch in batches:
            good = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), hundredths)
                    for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: full.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "hashes_a", "hashes_b")
    return joined.mapInArrow(kept, "a long, b long").distinct()


def _block_cuts(rows: pa.Table) -> list[tuple[int, int]]:
    """(start, end) of each pair of blocks in rows sorted by (group, one, two)."""
    keys = np.stack([rows.column(c).to_numpy() for c in ("group", "one", "two")])
    cuts = (np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, rows.num_rows]))


def _cross_links(members: DataFrame, full: DataFrame, similar: float) -> DataFrame:
    """Links between members of a candidate group that are in different components so far.

    Groups are compared in blocks of about ``BLOCK`` members: on sketches alone, then the members that have a
    likely partner in a pair of blocks meet there again with their full sets, which are sent
    nowhere else. A task gives one link for any two components that it joins.
    ``members``: group, blocks (of its group), id, component, n_shingles, sketch; ``full``: id, hashes.
    """
    hundredths = round(100 * similar)
    keys = ["group", "one", "two"]
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    placed = placed.select("group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "id", "component", "n_shingles", "sketch")
    sorted_blocks = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "id")

    def partners(i, end, part, n, registers):
        """The later rows of the block that are likely similar to row i and in another component."""
        js = np.arange(i + 1, end)[part[i + 1:end] != part[i]]
        if len(js) == 0:
            return js
        return js[likely(np.full(len(js), n[i]), n[js], (registers[i] > registers[js]).sum(axis=1), (registers[i] < registers[js]).sum(axis=1), similar)]

    def sketched(batches):
        for rows in runs(batches, 3):
            if rows.num_rows == 0:
                continue
            n, part, registers = rows.column("n_shingles").to_numpy().astype(float), rows.column("component").to_numpy(), _registers(rows.column("sketch"))
            found = np.zeros(rows.num_rows, bool)
            for start, end in _block_cuts(rows):
                for i in range(start, end):
                    js = partners(i, end, part, n, registers)
                    found[js] = True
                    found[i] |= len(js) > 0
            yield from rows.filter(pa.array(found)).to_batches()

    def compared(batches):
        for rows in runs(batches, 3):
            if rows.num_rows == 0:
                continue
            ids, n = rows.column("id").to_numpy(), rows.column("n_shingles").to_numpy().astype(float)
            registers, sets = _registers(rows.column("sketch")), rows.column("hashes").to_pylist()
            part = rows.column("component").to_numpy().copy()
            found = []
            for start, end in _block_cuts(rows):
                block = part[start:end]
                for i in range(start, end):
                    own = np.frombuffer(sets[i], np.uint64)
                    for j in partners(i, end, part, n, registers):
                        if part[j] != part[i] and _linked(own, np.frombuffer(sets[j], np.uint64), hundredths):
                            found.append((ids[i], ids[j]))
                            block[block == part[j]] = part[i]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    hopeful = stored(sorted_blocks(placed).mapInArrow(sketched, schema))
    return sorted_blocks(hopeful.join(full, "id").select(*keys, "id", "component", "n_shingles", "sketch", "hashes")).mapInArrow(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: classes of documents linked at ``similar`` Jaccard or more.

    Documents with equal sets are one representative. Every representative is first compared
    with one popular member of its band groups, which links a group of copies with as
    many pairs as it has members; members that are then still in different components
    are compared in blocks, so no candidate is left out. Texts without words, nulls and
    rows with a null id link with nothing; the latter have a null class and are kept. Rows
    that share an id are one document with several texts: a link of one holds for all.
    """
    made = stored(sketches(docs, id_col, text_col, size))
    sets = stored(made.filter("id IS NOT NULL AND print IS NOT NULL").groupBy("print").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    width = 2 * ROWS
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {width} + 1, {width})))")
    grouped = sets.select("id", F.explode(bands).alias("key"))
    shared = grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    members = stored(grouped.join(shared.select("key", "n"), "key").distinct())
    full = stored(_full_sets(docs, members.select("id").distinct(), id_col, text_col, size))

    popular = members.groupBy("id").agg(F.sum("n").alias("popularity"))
    centres = members.join(popular, "id").groupBy("key").agg(F.max_by("id", F.struct("popularity", -F.col("id"))).alias("centre"))
    stars = members.join(centres, "key").filter("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("n"))
    stars = stars.groupBy("id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    stars = stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = stored(_verified(_likely_pairs(stars, sets, similar), full, similar))

    placed = stored(members.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    unsettled = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first")).filter("low < high")
    open_members = stored(placed.join(unsettled.select("key", "first"), "key").select("id", "component", "first").distinct())
    # Members that share a band group, directly or through others, make a candidate group.
    groups = components(open_members.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    candidates = (open_members.select("id", "component").distinct().join(groups.withColumnRenamed("node", "id"), "id").join(sizes, "group")
                  .join(sets.select("id", "n_shingles", "sketch"), "id"))
    more = stored(_cross_links(candidates, full, similar))

    classes = components(links.union(more))
    by_print = sets.select("print", F.col("id").alias("node")).join(classes, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    named = made.join(by_print, "print", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return named.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The kept documents with all their columns; rows that share an id and a text are one."""
    kept = near_duplicates(docs, id_col, text_col, similar).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    found = docs.join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")
    return found.dropDuplicates([id_col, text_col])


@query("op5_near_dedup")
def near_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
