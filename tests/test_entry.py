"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
    assert entry.entry(spark).count() > 0
