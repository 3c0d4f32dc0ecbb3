import pytest
from parity import compare, connection

from ledgerloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, con, name):
    compare(spark, data, QUERIES[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
