import pytest

from __spark_entry__ import oracle_sql, queries
from siftwell.llm.queries import ORACLES, QUERIES
from verification.compare import connect, difference


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(key, spark, sf_dir):
    assert difference(QUERIES[key](spark, sf_dir), connect(sf_dir), ORACLES[key]) is None
