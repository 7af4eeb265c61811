"""Every query of the core runs over its whole tables; those that SQL can express give the rows of DuckDB."""

import pytest
from conftest import DATA, compare

from gleanworks.plans import registry

QUERIES, SQL = registry.queries(), registry.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns
    assert QUERIES[name](spark, DATA).count() >= 0
