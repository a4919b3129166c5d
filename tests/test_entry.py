"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["s1_id", "cand_id"] and got.count() > 0
