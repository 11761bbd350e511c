"""Every registered query against its SQL on the smallest tables."""

import pytest

from newsframe.catalog import ORACLES, QUERIES

from .oracle import connection, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    same(spark, con, QUERIES[name], ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect() is not None
