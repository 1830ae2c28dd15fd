"""The registered queries over whole tables, against plain SQL where there is some."""

import pytest
from oracle import assert_same, connect

from quillon.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert_same(spark, connection, Q.queries()[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert Q.queries()[name](spark, FOLDER).count() > 0
