import __spark_entry__


def test_entry_gives_the_flagship_summary(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["method", "n", "mean", "median", "std"] and df.count() == 5


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
