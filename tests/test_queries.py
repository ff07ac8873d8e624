"""Every query that has SQL gives the rows of that SQL on the smallest tables; the others give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame):
    own = frame[sorted(frame.columns)].itertuples(index=False)
    return sorted((tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in own), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert got.count() > 0
        return
    a, b = got.toPandas(), duck.execute(catalog.SQL[name]).fetch_df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
