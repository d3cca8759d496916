"""Every registered query against its oracle SQL, as the driver compares them."""

import pytest

import __spark_entry__ as entry

from .compare import difference, duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    assert got[1]
    if name in ORACLES:
        assert difference(got, duck_rows(con, ORACLES[name])) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["lecture_id", "part", "text"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
