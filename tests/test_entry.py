import __spark_entry__ as entry


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
