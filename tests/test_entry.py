import __spark_entry__


def test_entry_gives_the_log_likelihood(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.n_visited > 0 and row.log_likelihood < 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
