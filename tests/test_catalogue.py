"""Every query that SQL can express gives the rows of its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from peerlume.plans import catalogue

SF = "/root/testdata/sf0.001"


def _show(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_show(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    cursor = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(tuple(_show(r[i]) for i in place) for r in cursor.fetchall())
