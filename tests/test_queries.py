"""Every registered query against its SQL, and those without SQL for running whole."""

import pytest

from graphloom.queries import ORACLE, QUERIES
from oracle_check import connection, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
