"""Every query with SQL gives DuckDB's rows; the others run."""

import os

import duckdb
import pytest

from voxlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got
