"""Successors and walks against plain loops, in groups over many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lecturespark.operators import chains, messages


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plain_next(groups):
    out = []
    for g, rows in groups.items():
        for i, (_, least) in enumerate(rows):
            later = [j for j in range(i + 1, len(rows)) if least is not None and rows[j][0] is not None and rows[j][0] >= least]
            out += [(g, i, later[0])] if later else []
    return sorted(out)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_first_at_least(spark, monkeypatch, fan):
    monkeypatch.setattr(chains, "FAN", fan)
    rng = random.Random(fan)
    number = lambda top: rng.choice([None, rng.randrange(top), rng.randrange(top), rng.randrange(5)])
    groups = {g: [(number(40), number(45)) for _ in range(n)] for g, n in enumerate((1, 2, 7, 90, 150))}
    rows = spark.createDataFrame([(g, i, v, t) for g, r in groups.items() for i, (v, t) in enumerate(r)], "g INT, pos BIGINT, v BIGINT, t BIGINT")
    assert values(chains.first_at_least(rows, ["g"], "v", "t")) == plain_next(groups)


def test_walked(spark):
    steps = spark.createDataFrame([(1, i, i + 1) for i in range(37)] + [(2, i, i + 3) for i in range(20)], "g INT, pos BIGINT, next BIGINT")
    starts = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "g INT, pos BIGINT")
    want = [(1, i) for i in range(38)] + [(2, i) for i in range(1, 23, 3)] + [(3, 0)]
    assert values(chains.walked(steps, starts, ["g"])) == sorted(want)


def plain_throttle(rows):
    sent, out = {}, []
    for task, arrival, at, stage, done, total in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        last = sent.get(task)
        step = max(1, int(total * 0.02)) if total else None
        if last is None or stage != last[0] or at - last[1] >= 15_000_000 or (step and (done or 0) - last[2] >= step):
            sent[task] = (stage, at, done or 0)
            out.append((arrival,))
    return sorted(out)


def test_long_runs_are_the_loop(spark, monkeypatch):
    monkeypatch.setattr(chains, "FAN", 4)
    rng = random.Random(8)
    rows, at = [], 0
    for n in range(900):
        at += rng.choice([0, 200_000, 900_000, 3_000_000, 14_999_999] + [16_000_000] * (n % 150 == 0))
        # One task has most rows, in runs of hundreds; progress jumps back at times.
        task = rng.choice([1, 1, 1, 1, None, 2])
        rows.append((task, n, at, "asr" if n % 400 else "ocr", rng.choice([None, n % 260, n % 260, n % 90]), rng.choice([0, None, 300, 300, 2000, 40])))
    df = spark.createDataFrame([(*r[:4], "running", *r[4:], "e") for r in rows],
                               "task_id INT, arrival BIGINT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, total BIGINT, error_code STRING")
    want = plain_throttle(rows)
    for limits in ({}, {"fold_rows": 20}, {"fold_rows": 0, "rows_per_task": 100}):
        sent = messages.progress_throttle(df.repartition(5), ["task_id"], **limits)
        assert set(sent.columns) >= set(df.columns) and "pos" not in sent.columns
        assert values(sent.select("arrival")) == want
    plan = messages.progress_throttle(df, ["task_id"], fold_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_a_run_has_no_task_of_its_own(spark):
    rows = spark.createDataFrame([(1, i, i * 10_000, "asr", "running", i, 1000, "") for i in range(6000)],
                                 "task_id INT, arrival BIGINT, at_us BIGINT, stage STRING, status STRING, completed BIGINT, total BIGINT, error_code STRING")
    sent = messages.progress_throttle(rows, ["task_id"], fold_rows=100, rows_per_task=500)
    assert values(sent.select("arrival")) == [(i,) for i in range(0, 6000, 20)]
