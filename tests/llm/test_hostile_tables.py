"""All queries survive NULLs in any column, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from peerlume.llm import queries as q

SF = "/root/testdata/sf0.001"
TABLES = ("articles", "concerns", "concern_labels", "peerj_reviews", "source_state", "incoming", "documents")
FIXED = ("annotators", "split_targets", "sample_plans", "sample_targets", "placeholders", "containers")
CLASHING = ("key", "label", "n", "record", "group_no", "class_id", "kind", "word", "no", "seq", "size", "bin", "prose", "record_no", "obs", "item", "slot", "ids", "stratum", "units")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _make(spark, root, change):
    for t in (*TABLES, *FIXED):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (change(t, df) if t in TABLES else df).coalesce(1).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _make(spark, tmp_path_factory.mktemp("empty"), lambda t, df: df.where("false"))


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    def change(t, df):
        some = df.limit(40)
        nulls = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema) if t != "incoming" else some.limit(1).select(*[F.lit(None).cast(k).alias(c) if c not in ("incoming_no", "batch_no") else F.col(c) for c, k in df.dtypes])
        long = some.limit(1)
        for c in ("text", "abstract", "author_response_text", "author_response_raw"):
            if c in df.columns:
                long = long.withColumn(c, F.concat(F.repeat(F.lit("Dr. Ann Lee at ann@x.example, "), 20_000), F.repeat(F.lit("x"), 30_000)))
        odd = some.limit(2)
        for c in ("text", "title", "abstract", "author_response_text"):
            if c in df.columns:
                odd = odd.withColumn(c, F.lit("\x01x\x01  <\U0001f9ec|"))
        out = some.union(some.limit(5)).union(nulls).union(long).union(odd)
        return out.withColumns({c: F.lit("clash") for c in CLASHING if c not in out.columns})

    return _make(spark, tmp_path_factory.mktemp("hostile"), change)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty, name):
    got = q.QUERIES[name](spark, empty)
    n = got.count()
    assert n == (27 if name == "p5_found" or name == "p5_report" else 0)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - {"p7_roundtrip", "p8_report", "p9_signs", "p3_report", "p4_reliability"}))
def test_hostile_tables(spark, hostile, name):
    q.QUERIES[name](spark, hostile).collect()
