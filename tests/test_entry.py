import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "vec_topk_cosine" in entry.queries()


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
