"""Every registered query against its SQL in another engine."""

import pytest

import __spark_entry__ as contract
from tools.check import compare, database, kinds

from .conftest import SF

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def other_engine():
    with database(SF) as con:
        yield con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, other_engine, name):
    actual, expected = QUERIES[name](spark, SF).toPandas(), other_engine.execute(ORACLES[name]).df()
    assert compare(actual, expected) == ""
    assert kinds(actual) == kinds(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row["total"] > 0
    assert 0 < row["n_default"] < row["total"]
