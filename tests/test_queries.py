"""Every registered base query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seamark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    want = c.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
