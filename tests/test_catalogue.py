"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from passages import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted([tuple(norm(r[c]) for c in names) for r in df.collect()], key=repr)
    if name in catalogue.ORACLES:
        rel = con.sql(catalogue.ORACLES[name])
        at = [rel.columns.index(c) for c in names]
        assert got == sorted([tuple(norm(r[i]) for i in at) for r in rel.fetchall()], key=repr)
    else:
        assert got
