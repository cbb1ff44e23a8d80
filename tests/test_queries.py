"""Every registered query against its plain SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    note, ok = compare(QUERIES[name](spark, SF), ORACLES.get(name), con)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
