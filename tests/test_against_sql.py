"""Every registered query against the same result in DuckDB."""

import pytest

from __spark_entry__ import entry
from verification.compare import connect, difference
from verification.oracles import ORACLES
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf_dir, connection):
    assert difference(QUERIES[key](spark, sf_dir), connection, ORACLES[key]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
