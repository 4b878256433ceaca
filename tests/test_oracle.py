"""Every query with SQL against DuckDB over the same tables; every other one runs and has rows."""

import pytest

from lodestack.plans import catalog

from . import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, con, name):
    assert oracle.differences(QUERIES[name](spark, sf), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
