"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from lecturespark.llm import hard_negatives as d

SCHEMA = "vec_id long, embedding array<float>, label int, member long, tag string, cluster int, score string"


def plain_negatives(rows, every=50):
    good = {(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows
            if i is not None and v is not None and label is not None and None not in v and all(map(math.isfinite, v))}
    good = sorted(r for r in good if sum(x * x for x in r[2]) < 2 ** 62)
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for j, other, w in good if j != i)
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, k) for n, k, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(fit[:3], 1)]
    return sorted(set(out))


def check(spark, rows, every=50):
    vectors = spark.createDataFrame([(*r, 5, "clash", 5, "clash") for r in rows], SCHEMA)
    got = d.hard_negatives(vectors, f"id % {every} = 0")
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())
    want = plain_negatives(rows, every)
    assert got == want and want


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_clustered_vectors(spark, monkeypatch, spread):
    for name, value in (("MEMBERS_A_CLUSTER", 8), ("BLOCK", 7), ("PIECE", 31), ("CHUNK", 40), ("STEP", 8)):
        monkeypatch.setattr(d, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + spread * rng.normal(size=8)], int(rng.integers(0, 5))) for i in range(500)]
    check(spark, rows, every=8)


def test_copies_and_ties(spark, monkeypatch):
    for name, value in (("MEMBERS_A_CLUSTER", 2), ("BLOCK", 2), ("PIECE", 5), ("STEP", 4)):
        monkeypatch.setattr(d, name, value)
    rng = np.random.default_rng(6)
    pool = [[float(x) for x in rng.integers(-2, 3, size=4)] for _ in range(12)]
    rows = [(i, pool[0] if i % 3 == 0 else pool[int(rng.integers(0, 12))], int(rng.integers(0, 3))) for i in range(240)]
    rows += rows[:30]  # repeated rows are one
    rows += [(rows[40][0], pool[1], 0), (rows[41][0], rows[41][1], 9)]  # rows that share an id
    check(spark, rows, every=5)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (50, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (3, [2.0, 0.1], 2), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 2), (8, [1.0], 2), (9, [], 2), (10, [1.0, 2.0, 3.0], 1), (11, [1.0, 1.5], None), (None, [1.0, 1.0], 1), (100, [1.0, 1.2], 2), (100, [1.0, 1.2], 2),
            (12, [-1.0, -1.0], 1), (13, [3e38, 1.0], 2), (14, [1e5, 1e5], 3), (150, [-1.0, 0.0], 3), (15, [1e7, 1e7], 3), (200, [1e6, -5.0], 1), (16, [1e6, 3.0], 1), (17, [9e5, 1.0], 2)]
    check(spark, rows)


def test_empty_table(spark):
    assert d.hard_negatives(spark.createDataFrame([], SCHEMA), "id % 50 = 0").count() == 0
    assert d.hard_negatives(spark.createDataFrame([(1, [1.0], 1, 5, "", 5, "")], SCHEMA), "id % 50 = 0").count() == 0
