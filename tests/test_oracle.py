import pytest
from oracle import compare, connect

from quern.plans import catalogue

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, data, name):
    assert compare(spark, con, data, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, data, name):
    QUERIES[name](spark, data).collect()
