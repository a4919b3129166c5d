"""Every query that SQL can express gives the same rows as DuckDB."""

import math

import duckdb
import pytest
from linkweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
