import pytest
from compare import DATA, compare

from cladewise.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], DATA)


# p7_report and p8_found only choose other columns of what these two make
@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"p7_report", "p8_found"}))
def test_query_without_sql_runs(spark, name):
    assert Q.queries()[name](spark, DATA).count() >= 0
