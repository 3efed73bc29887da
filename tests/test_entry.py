import __spark_entry__ as entry


def test_registry_is_whole():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
