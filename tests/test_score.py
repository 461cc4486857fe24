"""Scores by matrix products are those of the join of postings, and all pairs never leave the tasks."""

import pickle
import random

import pytest

from peerlume.operators import retrieve, score
from peerlume.plans import catalogue

SF = "/root/testdata/sf0.001"
SCHEMA = "no bigint, text string, family string"


def rows(n=120):
    r = random.Random(5)
    some = [(i, " ".join(r.choices([f"word{j}" for j in range(60)], [1 / (j + 1) for j in range(60)], k=r.randint(1, 40))), f"f{i % 50}" if i % 3 else None) for i in range(n)]
    return some + [(n + i, t, f) for i, (_, t, f) in enumerate(some[:30])] + [(500, None, None), (501, " .", "f1"), (502, "nothing", None)]  # copies tie


@pytest.fixture(params=[(4_000_000, 512, 4096, (64, 512), 1_000_000), (700, 7, 11, (2, 5), 50)])
def sizes(request, monkeypatch):
    block, *values = request.param
    for name, v in zip(("ROWS", "COLS", "FIRST_COLS", "PAIRS"), values):
        monkeypatch.setattr(score, name, v)
    return block


def expected(spark, docs, queries, accept, k):
    hits = retrieve.search(retrieve.build_index(docs, "no", "text"), queries, "no", "text").collect()
    family = {r.no: r.family for r in docs.collect()}
    out = {}
    for h in sorted(hits, key=lambda h: (h.query, -round(h.score, 9), h.doc)):
        same = family[h.query] is not None and family[h.query] == family[h.doc]
        if accept == score.ANY or (h.doc != h.query and same == (accept == score.RELATIVES)):
            out.setdefault(h.query, []).append((h.doc, round(h.score, 6)))
    return {q: v[:k] for q, v in out.items()}


def test_best_are_those_of_the_join(spark, sizes):
    docs = spark.createDataFrame(rows(), SCHEMA)
    queries = docs.where("no % 4 = 0 or no > 500")
    for accept, k in ((score.ANY, 8), (score.OTHERS, 8), (score.RELATIVES, 1)):
        hits = score.best(score.corpus(docs, "no", "text", "family"), queries, "no", "text", "family", k, accept, sizes)
        found = {}
        for r in sorted(hits.collect(), key=lambda h: (h.query, -round(h.score, 9), h.doc)):
            found.setdefault(r.query, []).append((r.doc, round(r.score, 6)))
        assert {q: v[:k] for q, v in found.items()} == expected(spark, docs, queries, accept, k)


def test_no_document_has_a_token(spark):
    docs = spark.createDataFrame([(1, "", None), (2, None, "f")], SCHEMA)
    assert score.best(score.corpus(docs, "no", "text", "family"), docs, "no", "text", "family", 8).collect() == []


def pairs_stay(spark, name):
    """Whether the plan forms no row for a (query, document) pair outside the tasks of the documents."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return "MapInArrow" in plan and "weight" not in plan.split("MapInArrow")[1]


def test_concerns_keep_their_pairs(spark):
    assert pairs_stay(spark, "bm25_concerns")


def test_filtered_keeps_its_pairs(spark):
    assert pairs_stay(spark, "bm25_family_filtered")


def test_topk_keeps_its_pairs(spark):
    assert pairs_stay(spark, "bm25_topk")


def test_first_ranks_are_those_of_the_join(spark, sizes):
    docs = spark.createDataFrame(rows(), SCHEMA)
    queries = docs.where("no % 4 = 0 or no > 500")
    hits = retrieve.search(retrieve.build_index(docs, "no", "text"), queries, "no", "text")
    plain = retrieve.first_relative_rank(hits, docs.withColumnRenamed("no", "entry_no"))
    ranks = score.first_ranks(score.corpus(docs, "no", "text", "family"), queries, "no", "text", "family", sizes)
    found = sorted((r.query, r["rank"]) for r in ranks.collect())
    assert found == sorted((r.query, r["rank"]) for r in plain.collect()) and len(found) > 15


def test_family_ranks_form_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "search", None)  # the join that forms all pairs; few articles of SF have relatives
    assert catalogue.QUERIES["first_family_rank"](spark, SF).columns == ["query", "rank"]


def test_workers_need_no_package(spark, monkeypatch):
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or plain(self, value))
    docs = spark.createDataFrame(rows(), SCHEMA)
    score.best(score.corpus(docs, "no", "text", "family"), docs, "no", "text", "family", 8)
    score.first_ranks(score.corpus(docs, "no", "text", "family"), docs, "no", "text", "family")
    assert len(sent) == 3 and not any(b"peerlume" in x for x in sent)
