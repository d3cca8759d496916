"""Embedding dedup against all pairs."""

import numpy as np
import pytest

from lecturespark.llm import embedding_dedup as e

from .plain import classes

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def expected(rows):
    def good(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    used = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if good(i, v, label)]
    links = [(a[0], b[0]) for n, a in enumerate(used) for b in used[n + 1:] if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    label = classes([i for i, *_ in rows if i is not None], links)
    return sorted(((i, sum((x == i) + (y == i) for x, y in links), label.get(i), i == label.get(i)) for i, *_ in rows), key=repr)


def vectors(seed, count=150, size=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        base = rng.normal(size=size)
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            rows.append((base + rng.normal(size=size) * rng.choice([0, 0.02, 0.13, 0.2])).tolist())
    return rows


@pytest.mark.parametrize("block", [e.BLOCK, 40])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "CHUNK", block)
    monkeypatch.setattr(e, "LEAF", 4)
    rng = np.random.default_rng(3)
    rows = [(i, v, int(rng.choice([0, 0, 0, 1, 2]))) for i, v in enumerate(vectors(1))]
    one = rows[0][1]
    rows += [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [None, *one[1:]], 0), (9005, [float("nan"), *one[1:]], 0), (9006, [float("inf"), *one[1:]], 0),
             (9007, one, None), (None, one, 0), (9008, one, rows[0][2]), (9009, [3 * x for x in one], rows[0][2]), (9010, one[:8], rows[0][2]), (9011, [1.0], 7), (9012, [2.0], 7), (9013, [-1.0], 7)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in e.embedding_duplicates(df).collect()), key=repr)
    assert got == expected(rows)


def test_trees_cover_and_whole_sets_link():
    rng = np.random.default_rng(5)
    points = rng.normal(size=8) + rng.normal(size=(400, 8)) * 0.01
    points = np.concatenate([points, rng.normal(size=(200, 8))])
    points /= np.sqrt((points ** 2).sum(axis=1))[:, None]
    todo = [e.cover_tree(points)]
    while todo:
        node = todo.pop()
        assert np.sqrt(np.maximum(0, 2 - 2 * points[node.points] @ points[node.centre])).max() <= node.radius + e.SLACK
        if node.children:
            assert sorted(i for c in node.children for i in c.points) == sorted(node.points)
            assert all(c.radius <= node.radius / 2 for c in node.children)
            todo += node.children
    one, two, whole = e.linked(points, None, 0.98)
    found = set(zip(one.tolist(), two.tolist())) | {(i, j) for a, b in whole for i in a.tolist() for j in b.tolist()}
    assert whole and found == set(zip(*[x.tolist() for x in np.nonzero(points @ points.T >= 0.98)]))


def test_one_label_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 8)
    monkeypatch.setattr(e, "CHUNK", 100)
    monkeypatch.setattr(e, "LEAF", 2)
    rows = [(i, v, 0) for i, v in enumerate(vectors(2, 320, 12))]
    assert len(rows) > 64 * 8
    got = sorted((tuple(r) for r in e.embedding_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(4)).collect()), key=repr)
    assert got == expected(rows)


def test_one_direction_is_split(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 8)
    rows = [(i, [0.5 + i, 0.0], 0) for i in range(100)]
    got = e.embedding_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_pairs_of_blocks_follow_the_clusters(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    rng = np.random.default_rng(8)
    units = np.concatenate([c + rng.normal(size=(40, 32)) * 0.002 for c in rng.normal(size=(30, 32))])
    units /= np.sqrt((units ** 2).sum(axis=1))[:, None]
    nodes = spark.createDataFrame([("g", i, i, 1, bytearray(u.tobytes())) for i, u in enumerate(units)], "`group` string, node long, rep long, copies long, unit binary")
    points, edges, levels = e.upper_tree(nodes)
    sizes = {r.cell: r["count"] for r in points.groupBy("cell").count().collect()}
    assert levels >= 1 and sum(sizes.values()) == len(units) and max(sizes.values()) <= 16
    roots = nodes.select(e.F.lit("gg").alias("cell")).distinct()
    pairs = [tuple(r) for r in e.block_pairs(roots, edges, levels, 0.2).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs) < len(sizes) ** 2 / 8
    place = dict(points.select("node", "cell").collect())
    met = {frozenset(p) for p in pairs}
    assert all(frozenset((place[i], place[j])) in met for i, j in zip(*np.nonzero(units @ units.T >= 0.98)))


def test_empty_table(spark):
    assert e.embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
