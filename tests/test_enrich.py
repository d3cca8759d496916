"""Requests and their log: every stored digest is asked once, whatever dies in between."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lecturespark.operators import enrich


def counting_model(calls, poison=None):
    """A model that notes every call in a file and dies with its worker at the poisoned request."""

    def make():
        def model(request):
            if poison is not None and request == poison and not os.path.exists(f"{calls}.died"):
                open(f"{calls}.died", "w").close()
                os._exit(1)
            with open(calls, "a") as out:
                out.write(f"{request}\n")
            if request.startswith("bad"):
                raise ValueError(request)
            return request.upper()

        return model

    return make


def asked(calls):
    return Counter(open(calls).read().split()) if os.path.exists(calls) else Counter()


def requests_of(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("request"))


def test_a_killed_partition_repeats_no_stored_request(spark, tmp_path):
    log, calls, rows = str(tmp_path / "log"), str(tmp_path / "calls"), requests_of(spark, 120)
    with pytest.raises(Exception):
        enrich.enrich_windows(rows, counting_model(calls, "r60"), log=log, piece=4, calls_at_once=6)
    stored = {r["digest"] for r in enrich.logged_answers(spark, log).collect()}
    named = {r["request"] for r in rows.withColumn("digest", enrich.request_digest(F.col("request"))).collect() if r["digest"] in stored}
    assert 0 < len(named) < 120 and "r60" not in named
    got = enrich.enrich_windows(rows, counting_model(calls, "r60"), log=log, piece=4, calls_at_once=6).collect()
    assert sorted((r["id"], r["response"], r["error"]) for r in got) == [(i, f"R{i}", None) for i in range(120)]
    times = asked(calls)
    assert all(times[r] == 1 for r in named) and set(times) == {f"r{i}" for i in range(120)}


def test_equal_requests_are_asked_once_and_never_again(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"r{i}", "old") for i in range(30)] + [(99, None, "old")], "id INT, request STRING, response STRING")
    for _ in range(2):
        got = enrich.enrich_windows(rows, counting_model(calls), log=log)
        assert got.count() == 31 and got.where("response = 'SAME'").count() == 20
        assert got.where("id = 99").select("response", "error").collect() == [(None, None)]
    assert set(asked(calls).values()) == {1}
    enrich.enrich_windows(rows, counting_model(calls), log=log, model_name="other").count()
    assert set(asked(calls).values()) == {2}


def test_failed_requests_are_asked_again(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    rows = spark.createDataFrame([("bad1",), ("good",)], "request STRING")
    for n in (1, 2):
        got = enrich.enrich_windows(rows, counting_model(calls), log=log).collect()
        assert sorted((r["request"], r["response"], r["error"]) for r in got) == [("bad1", None, "ValueError"), ("good", "GOOD", None)]
        assert asked(calls) == {"bad1": n, "good": 1}


def test_no_requests(spark, tmp_path):
    rows = spark.createDataFrame([], "id INT, request STRING")
    assert enrich.enrich_windows(rows, counting_model(str(tmp_path / "calls")), log=str(tmp_path / "log")).count() == 0
