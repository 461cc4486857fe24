"""Every article is a query, not only those of some numbers."""

import os

import pytest

from peerlume.plans import analysis, catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_article_gets_concerns(spark):
    found = {r.query for r in catalogue.QUERIES["bm25_concerns"](spark, SF).select("query").distinct().collect()}
    assert found == {r.entry_no for r in spark.read.parquet(f"{SF}/articles.parquet").collect()}


def test_every_article_is_filtered_by_family(spark):
    found = {r.query for r in catalogue.QUERIES["bm25_family_filtered"](spark, SF).select("query").distinct().collect()}
    assert found == {r.entry_no for r in spark.read.parquet(f"{SF}/articles.parquet").collect()}


def test_every_article_with_a_relative_gets_a_rank(spark):
    found = {r.query for r in catalogue.QUERIES["first_family_rank"](spark, SF).collect()}
    docs, _, _ = analysis._corpus(spark, SF)
    families = {}
    for r in docs.where("family is not null").select("entry_no", "family").collect():
        families.setdefault(r.family, set()).add(r.entry_no)
    kin = set().union(*(f for f in families.values() if len(f) > 1))
    assert kin <= found and any(q % 20 for q in kin)
