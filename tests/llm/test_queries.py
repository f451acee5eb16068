"""The registered queries against their SQL on the smallest tables, and without it for their rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from passages.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([tuple(r[c] for c in names) for r in df.collect()], key=repr)
    if name in queries.oracle_sql():
        rel = con.sql(queries.oracle_sql()[name])
        at = [rel.columns.index(c) for c in names]
        assert got == sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=repr)
    elif name == "op1_html":
        assert len(got) == 50
    else:
        assert len(got) == 200


def test_entry_registers_all():
    assert {*queries.queries(), "pipeline"} <= set(__spark_entry__.queries())
