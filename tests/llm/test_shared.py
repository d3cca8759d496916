"""Helpers of the operators against plain versions."""

import random

from pyspark.sql import functions as F

from lecturespark.llm import shared

from .plain import classes


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(3099, 3000 + i) for i in range(99)] + [(5, 5), (4000, 4000), links[0]]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in shared.components(df).collect()} == classes(nodes, [x for x in links if x[0] != x[1]])
    assert shared.components(df.limit(0)).count() == 0


def test_running_totals(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, n long").repartition(7)
    got = {r.id: r.total for r in shared.running_totals(df, [F.col("k").desc(), F.col("id")], {"total": "n"}).collect()}
    total = 0
    for i, k, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        assert got[i] == total
        total += n
    assert len(got) == len(rows)
