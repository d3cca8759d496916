"""Generations: which folders count, what a batch writes and reads, and two writers at once."""

import os

import pytest
from pyspark.sql import functions as F

from lecturespark.sources import generations as g
from lecturespark.sources import jobs
from lecturespark.streaming import carried, sinks


def values(df):
    return sorted(tuple(r) for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_cover_is_disjoint_and_whole():
    found = [(i, i) for i in range(30)] + [(0, 7), (8, 15), (16, 23)]
    assert g.cover(found) == [(i, i) for i in range(29, 23, -1)] + [(16, 23), (8, 15), (0, 7)]
    assert g.cover(found, upto=9) == [(9, 9), (8, 8), (0, 7)]
    assert g.cover(found, upto=15, since=8) == [(8, 15)]
    assert g.cover([]) == [] and g.cover([(3, 3)], upto=2) == []


def test_cost_of_a_batch_follows_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(g, "FAN", 4)
    path, first = str(tmp_path / "t"), 4000
    g.append(spark.range(first).select(F.col("id").alias("k"), F.lit(0).alias("v")), path, 0, ["k"])
    written = []
    for n in range(1, 18):
        rows = spark.createDataFrame([(i, n) for i in (n, n + 1, 5000 + n)], "k BIGINT, v INT")
        g.append(rows, path, n, ["k"])
        written.append(size(f"{path}/gen={n}to{n}"))
        g.merge_tiers(spark, path, n, g.newest(["k"]))
        g.forget(spark, path, n)
        assert len(g.cover(g.spans(spark, path))) <= 7
    assert max(written) < size(f"{path}/gen=0to15") / 5 and not os.path.exists(f"{path}/gen=0to0")
    want = {i: 0 for i in range(first)} | {i: max(1, i if i <= 17 else 17) for i in range(1, 19)} | {5000 + n: n for n in range(1, 18)}
    assert values(sinks.latest_rows(spark, path, ["k"])) == sorted(want.items())
    # A batch reads the buckets of its keys only, and nothing of its own number or later.
    batch = spark.createDataFrame([(3,)], "k BIGINT")
    rows = carried.carried_rows(spark, path, 17, batch, ["k"], g.newest(["k"]))
    assert values(rows) == [(3, 3)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "b")], [(1, "c")]):
        g.append(spark.createDataFrame(rows, "k INT, v STRING"), path, 0, ["k"])
    assert values(sinks.latest_rows(spark, path, ["k"])) == [(1, "c")]


def test_a_batch_without_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    g.append(spark.createDataFrame([], "k INT, v STRING"), path, 0, ["k"])
    assert g.read(spark, path, g.cover(g.spans(spark, path))) is None
    g.append(spark.createDataFrame([(None, "n"), (1, None)], "k INT, v STRING"), path, 1, ["k"])
    assert sorted(map(str, sinks.latest_rows(spark, path, ["k"]).collect())) == ["Row(k=1, v=None)", "Row(k=None, v='n')"]


def test_interleaved_writers_store_a_hash_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    rows = lambda name: spark.createDataFrame([(f"h{i}", name) for i in range(20)] + [(name, name)], "input_hash STRING, v STRING")
    claim, tried = g.claim, []

    def between(session, trial, folder):
        # Another writer compares and commits after this one has compared.
        if not tried:
            tried.append(folder)
            jobs.write_results(rows("second"), path, "v")
        return claim(session, trial, folder)

    monkeypatch.setattr(g, "claim", between)
    jobs.write_results(rows("first"), path, "v")
    got = values(jobs.read_results(spark, path).select("input_hash", "v"))
    assert got == sorted([(f"h{i}", "second") for i in range(20)] + [("second", "second"), ("first", "first")])
    assert not [f for f in os.listdir(path) if f.startswith("_try")]


def test_results_read_the_buckets_of_their_hashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(g, "FAN", 2)
    path = str(tmp_path / "results")
    for n in range(5):
        jobs.write_results(spark.range(n * 50, n * 50 + 60).select(F.concat(F.lit("h"), "id").alias("input_hash"), "id"), path, "id")
    assert values(jobs.read_results(spark, path).select("id")) == [(i,) for i in range(260)]
    assert g.cover(g.spans(spark, path)) == [(4, 4), (0, 3)]
    plan = jobs.unstored(spark.createDataFrame([("h7", 1), ("new", 2)], "input_hash STRING, id BIGINT"), path, "id")
    assert [r["input_hash"] for r in plan.collect()] == ["new"]
    scans = [line for line in plan._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert any("bucket" in s.split("PartitionFilters:")[1].split("]")[0] for s in scans)
