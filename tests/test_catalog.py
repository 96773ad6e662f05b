"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
import os

import duckdb
import pytest

from tidewright.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, float):
        return f"{x + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = df.collect()
    if name in oracle_sql():
        want = duck.sql(oracle_sql()[name])
        columns = sorted(df.columns)
        assert sorted(want.columns) == columns
        place = [want.columns.index(c) for c in columns]
        assert sorted([plain(r[c]) for c in columns] for r in got) == sorted([plain(r[i]) for i in place] for r in want.fetchall())
