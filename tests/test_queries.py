"""Every registered query of the core against its SQL on the smallest tables."""

import pytest
from compare import DATA, compare

from cladewise.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_names_of_sql_are_queries():
    assert set(SQL) <= set(QUERIES)
