"""Embedding near-dedup by dual traversal of cover trees.

Vectors of a label are dealt to the nearest of a few pivots, and so again inside every
cell that is still larger than a block: the upper levels of the tree, each with its
covering ball, spread over all tasks. Pairs of cells are walked down these levels as
rows. Pairs of blocks whose balls come near each other then go to one task, which builds
a cover tree of each, with radii that halve from level to level, and walks both trees
together. Everywhere a pair of nodes too far apart is dropped, and in a task one that lies
together entirely is counted whole. The result is every pair at the threshold, counted and
not listed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .shared import components, stored
from .words import runs

COSINE, BLOCK, PIVOTS, CHUNK = 0.98, 2048, 64, 4096
LEAF = 48
SLACK = 1e-6  # above the rounding of distances near 0
TIED = 1e-12  # cosines closer than this are ties


@dataclass
class Node:
    points: np.ndarray  # indices of all points below
    centre: int
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(vectors: np.ndarray) -> Node:
    """Nested levels: the children of a node of radius r cover its points with radius r / 2."""

    def distances(centre: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (vectors[points] @ vectors[centre])))

    root_points = np.arange(len(vectors))
    away = distances(0, root_points)
    root = Node(root_points, 0, float(away.max()))
    todo = [(root, away)]
    while todo:
        node, away = todo.pop()
        if len(node.points) <= LEAF or node.radius <= SLACK:
            continue
        left, centre, half = node.points, node.centre, node.radius / 2
        while len(left):
            near = away <= half
            mine, its = left[near], away[near]
            child = Node(mine, centre, float(its.max()))
            node.children.append(child)
            todo.append((child, its))
            left = left[~near]
            if len(left):
                centre = int(left[0])
                away = distances(centre, left)
    return root


def linked(a: np.ndarray, b: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of unit vectors of a and b (of a alone if b is None) with cosine ``least`` or more.

    As index pairs, and as pairs of whole point sets of which every pair is linked.
    """
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    first = cover_tree(a)
    other, second = (a, first) if b is None else (b, cover_tree(b))
    ones, twos, whole = [], [], []
    todo = [([first], [second])]
    while todo:
        left, right = todo.pop()
        apart = np.sqrt(np.maximum(0, 2 - 2 * (a[[n.centre for n in left]] @ other[[n.centre for n in right]].T)))
        balls = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None, :]
        near = apart <= reach + balls
        inside = near & (apart + balls <= reach - 3 * SLACK)
        for i, j in zip(*np.nonzero(near)):
            x, y = left[i], right[j]
            if inside[i, j]:
                whole.append((x.points, y.points))
            elif not x.children and not y.children:
                found = np.nonzero(a[x.points] @ other[y.points].T >= least)
                ones.append(x.points[found[0]])
                twos.append(y.points[found[1]])
            else:
                todo.append((x.children or [x], y.children or [y]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *ones]), np.concatenate([none, *twos]), whole


def _joined(size: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least index that each of ``size`` points reaches."""
    label = np.arange(size)
    while len(one):
        low = np.minimum(label[one], label[two])
        before = label.copy()
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, group, print, unit) per row: ``group`` is label and length, ``print`` equal for equal vectors; nulls where nothing can link."""

    def made(batches):
        for batch in batches:
            prints, units, groups = [], [], []
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends, flat = np.cumsum(lengths), pc.list_flatten(lists)
            nulls = np.concatenate([[0], np.cumsum(pc.is_null(flat).to_numpy(zero_copy_only=False))])
            values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.0
            for end, n, label in zip(ends, lengths, batch.column(2).to_pylist()):
                point = values[end - n:end]
                good = label is not None and n > 0 and nulls[end] == nulls[end - n]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    scaled = point / np.abs(point).max() if good else point
                    unit = scaled / np.sqrt(scaled @ scaled) if good else point
                good = good and bool(np.isfinite(unit).all())
                groups.append(f"{n}:{label}" if good else None)
                prints.append(hashlib.blake2b(point.tobytes(), digest_size=16).digest() if good else None)
                units.append(unit.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string()), pa.array(prints, pa.binary()), pa.array(units, pa.binary())],
                                             ["id", "group", "print", "unit"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col, F.col(label_col).cast("string")).mapInArrow(
        made, "id long, `group` string, `print` binary, unit binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _groups(rows: pa.Table, keys: list[str]):
    """(start, end) of each group of a table sorted by ``keys``."""
    columns = [rows.column(k).to_numpy() for k in keys]
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    cuts = (np.flatnonzero(changed) + 1).tolist()
    return zip([0, *cuts], [*cuts, rows.num_rows])


POINT = ["node", "rep", "copies", "unit"]


def _dealt(points: DataFrame, large: DataFrame, level: int) -> DataFrame:
    """The points of ``large`` cells with the cell of their nearest pivot, its centre and the distance to it.

    A cell has a few hash-chosen pivots, in proportion to its size and ``PIVOTS`` at most on
    average; they are sent to every chunk of the cell's points. Ties are broken by hash, so
    that vectors of one direction are split as well. A cell that happens to have no pivot stays
    as it is until the next level, which chooses anew.
    """
    placed = points.join(large, "cell").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK)).cast("int"))
    wanted = F.least(F.greatest(F.ceil(2 * F.col("size") / BLOCK), F.lit(4)), F.lit(PIVOTS))
    pivots = placed.filter(F.pmod(F.xxhash64(F.lit("pivot"), F.lit(level), "node"), F.col("size")) < wanted)
    sent = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / CHUNK).cast("int") - 1)))
    fields = ["cell", "chunk", "kind", "tie", *POINT]
    tie = F.pmod(F.xxhash64(F.lit("tie"), F.lit(level), "node"), F.lit(1 << 30))
    rows = sent.withColumns({"kind": F.lit(0), "tie": tie}).select(*fields).union(placed.withColumns({"kind": F.lit(1), "tie": tie}).select(*fields))

    def nearest(batches):
        for rows in runs(batches, 2):
            for a, b in _groups(rows, ["cell", "chunk"]) if rows.num_rows else ():
                part = rows.slice(a, b - a)
                n_pivots = int((part.column("kind").to_numpy() == 0).sum())
                own = part.slice(n_pivots)
                parent = own.column("cell")
                units = _matrix(part.column("unit"))
                points, pivots = units[n_pivots:], units[:n_pivots]
                own = own.select(POINT).append_column("parent", parent)
                if n_pivots == 0:
                    none = pa.nulls(len(own))
                    yield from (own.append_column("cell", parent).append_column("centre", none.cast(pa.binary()))
                                .append_column("away", none.cast(pa.float64())).to_batches())
                    continue
                cosines = points @ pivots.T
                tied = cosines >= cosines.max(axis=1, keepdims=True) - TIED
                turn = part.column("tie").to_numpy()[n_pivots:] % tied.sum(axis=1)
                to = (np.cumsum(tied, axis=1) > turn[:, None]).argmax(axis=1)
                away = np.sqrt(np.maximum(0, 2 - 2 * cosines[np.arange(len(to)), to]))
                names = pa.array([f"{level}:{node}" for node in part.column("node").to_numpy()[:n_pivots]])
                yield from (own.append_column("cell", names.take(pa.array(to)))
                            .append_column("centre", pa.array([p.tobytes() for p in pivots], pa.binary()).take(pa.array(to)))
                            .append_column("away", pa.array(away)).to_batches())

    return rows.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind", "node").mapInArrow(
        nearest, "node long, rep long, copies long, unit binary, parent string, cell string, centre binary, away double")


def upper_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(points with their block, edges, levels) of the tree above the blocks; its roots are the groups.

    Every level deals the cells that hold over ``BLOCK`` points, until none does. An edge is
    (parent, cell, centre, radius) with the ball that covers the cell.
    """
    points = nodes.select(F.concat(F.lit("g"), "group").alias("cell"), *POINT)
    blocks, edges, level = [], [], 0
    while True:
        sizes = stored(points.groupBy("cell").agg(F.count("*").alias("size")))
        large = sizes.filter(F.col("size") > BLOCK)
        if large.isEmpty():
            blocks.append(points)
            break
        blocks.append(points.join(sizes.filter(F.col("size") <= BLOCK), "cell", "left_semi"))
        level += 1
        dealt = stored(_dealt(points, large, level))
        edges.append(dealt.filter("cell <> parent").groupBy("parent", "cell").agg(F.first("centre").alias("centre"), F.max("away").alias("radius")))
        points = dealt.select("cell", *POINT)
    return stored(reduce(DataFrame.union, blocks)), stored(reduce(DataFrame.union, edges)) if edges else None, level


def block_pairs(roots: DataFrame, edges: DataFrame | None, levels: int, reach: float) -> DataFrame:
    """(x, y): the pairs of blocks, each with itself too, whose points may be within ``reach``.

    Pairs of cells start at the roots (a column ``cell``) and open level by level; a pair whose balls
    are further apart is dropped with all that is below.
    """
    pairs = roots.select(F.col("cell").alias("x"), F.col("cell").alias("y"))
    if edges is None:
        return pairs

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                apart = np.sqrt(np.maximum(0, 2 - 2 * _dots(batch)))
                balls = batch.column("x_radius").to_numpy() + batch.column("y_radius").to_numpy()
                yield batch.filter(pa.array(apart <= reach + balls)).select(["x", "y"])

    below = lambda at: edges.select(F.col("parent").alias(at), F.col("cell").alias(f"{at}_cell"))
    ball = lambda at: edges.select(F.col("cell").alias(at), F.col("centre").alias(f"{at}_centre"), F.col("radius").alias(f"{at}_radius"))
    for _ in range(levels):
        opened = pairs.join(below("x"), "x", "left").join(below("y"), "y", "left")
        opened = opened.withColumn("same", F.col("x") == F.col("y")).select("same", F.coalesce("x_cell", "x").alias("x"), F.coalesce("y_cell", "y").alias("y"))
        opened = opened.filter("NOT same OR x <= y")
        # A cell meets itself in any case; different cells are below a root and have balls.
        apart = opened.filter("x <> y").join(ball("x"), "x").join(ball("y"), "y").select("x", "y", "x_radius", "y_radius", "x_centre", "y_centre")
        pairs = stored(opened.filter("x = y").select("x", "y").union(apart.mapInArrow(near, "x string, y string")))
    return pairs


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                         cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links of vectors of one label with cosine ``cosine`` or more.

    Equal vectors are one node with a number of copies. Null labels, null, empty and zero
    vectors, those with a null or non-finite component, and rows with a null id link
    with nothing; a null id has a null class and is kept. Vectors of different lengths
    never link. Repeated rows are vectors of their own: each counts the others as links.
    """
    made = stored(unit_vectors(vectors, id_col, vector_col, label_col))
    usable = made.filter("id IS NOT NULL AND `print` IS NOT NULL")
    nodes = stored(usable.groupBy("group", "print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
                   .withColumn("node", F.monotonically_increasing_id()))
    points, edges, levels = upper_tree(nodes)
    points = points.withColumnRenamed("cell", "block")
    roots = nodes.select(F.concat(F.lit("g"), "group").alias("cell")).distinct()
    pairs = block_pairs(roots, edges, levels, float(np.sqrt(2 - 2 * cosine)) + SLACK)
    tasks = (points.join(pairs, F.col("block") == F.col("x")).withColumn("side", F.lit(0))
             .union(points.join(pairs, F.col("block") == F.col("y")).filter("x <> y").withColumn("side", F.lit(1))))

    def counted(batches):
        for rows in runs(batches, 2):
            for a, b in _groups(rows, ["x", "y"]) if rows.num_rows else ():
                part = rows.slice(a, b - a)
                units, copies, node, rep = _matrix(part.column("unit")), *(part.column(c).to_numpy() for c in ("copies", "node", "rep"))
                own = part.column("x")[0].as_py() == part.column("y")[0].as_py()
                n = len(units) if own else int((part.column("side").to_numpy() == 0).sum())
                one, two, whole = linked(units[:n], None if own else units[n:], cosine)
                shift = 0 if own else n
                two = two + shift
                total = np.bincount(one, copies[two], len(units))
                if not own:
                    total += np.bincount(two, copies[one], len(units))
                stars = []
                for left, right in whole:
                    right = right + shift
                    total[left] += copies[right].sum()
                    if not own:
                        total[right] += copies[left].sum()
                    stars.append(np.concatenate([left, right]))
                if own:
                    total -= copies  # itself
                centre = np.concatenate([one, *[np.full(len(s), s[0]) for s in stars]])
                around = np.concatenate([two, *stars])
                label = _joined(len(units), centre, around)
                some = np.flatnonzero(total > 0)
                least = np.full(len(units), np.iinfo(np.int64).max)
                np.minimum.at(least, label, rep)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(rep[some]), pa.array(total[some].astype(np.int64)), pa.array(least[label[some]])],
                                                 ["node", "rep", "n", "peer"])

    found = stored(tasks.select("x", "y", "side", "node", "rep", "copies", "unit").repartition("x", "y").sortWithinPartitions("x", "y", "side", "node")
                   .mapInArrow(counted, "node long, rep long, n long, peer long"))
    totals = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.filter("rep <> peer").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    named = (nodes.join(totals, "node", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .select("group", "print", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    result = made.withColumn("usable", F.col("id").isNotNull()).join(named, ["group", "print"], "left")
    component = F.when(F.col("usable"), F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_col), F.when(F.col("usable"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _dots(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)
                     for x, y in zip(batch.column("x_centre").to_pylist(), batch.column("y_centre").to_pylist())])


@query("op10_embedding_dedup")
def embedding_query(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_duplicates(table(spark, folder, "embeddings"))
