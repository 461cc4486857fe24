"""Queries agree with their SQL on whole tables, packing keeps its promises."""

import glob
import os

import duckdb
import pytest

from peerlume.llm import packing
from peerlume.llm import queries as q
from tests.test_catalogue import _show

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(q.SQL[name])
    place = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(tuple(_show(r[i]) for i in place) for r in cursor.fetchall())
    assert sorted(tuple(_show(r[c]) for c in columns) for r in df.collect()) == want


def test_packing_places_every_token_once_within_the_capacity(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, [0, 3, 17, 64, 65, 150, 5][i % 7]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc bigint, source string, n int")
    got = packing.pack(df, "doc", "source", "n", [(1, 64), (2, 200)], shard_tokens=3000).collect()
    for container, capacity in ((1, 64), (2, 200)):
        mine = [r for r in got if r.container_id == container]
        pieces, bins = {}, {}
        for r in mine:
            pieces.setdefault(r.doc, []).append((r.start_token, r.n_tokens))
            bins[r.bin] = bins.get(r.bin, 0) + r.n_tokens
        assert max(bins.values()) <= capacity
        for doc, _, n in rows:
            spans = sorted(p for p in pieces.get(doc, []) if p[1] > 0)
            assert [a for a, _ in spans] == [sum(x for _, x in spans[:k]) for k in range(len(spans))] and sum(x for _, x in spans) == n
            assert len(spans) <= 1 or n > capacity  # nothing else is cut
        assert sum(bins.values()) / (capacity * len([b for b in bins.values() if b])) > 0.85
