"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quernel.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False, name=None):
        rows.append(tuple(None if x is None or x is pd.NA or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x) for x in r))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
