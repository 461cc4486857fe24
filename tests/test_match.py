import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerlume.operators import match, metrics

EDGES = "model string, entry_no bigint, tool_no bigint, ref_no bigint, score double"


def edges(spark, matrix):
    return spark.createDataFrame([("m", 1, i, j, float(s)) for i, row in enumerate(matrix) for j, s in enumerate(row)], EDGES)


def test_optimal_matching_prefers_more_pairs_than_greedy(spark):
    e = edges(spark, [[1.0, 0.65], [0.65, 0.64]])
    assert match.greedy_matches(e, 0.65).count() == 1
    assert sorted((r.tool_no, r.ref_no) for r in match.hungarian_matches(e, 0.65).collect()) == [(0, 1), (1, 0)]


def test_greedy_breaks_ties_downwards(spark):
    e = edges(spark, [[0.5, 0.5], [0.5, 0.5]])
    assert sorted((r.tool_no, r.ref_no) for r in match.greedy_matches(e, 0.5).collect()) == [(0, 0), (1, 1)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = match.assignment(cost)
    assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
    c = cost if n <= m else cost.T
    best = min(sum(c[i, j] for i, j in zip(rows, p)) for p in itertools.permutations(cols, len(rows)))
    assert sum(cost[i, j] for i, j in got) == best


def test_article_without_reference_still_counts_predictions(spark):
    articles = spark.createDataFrame([(1,), (2,)], "entry_no bigint")
    ref = spark.createDataFrame([(10, 1, "sample size too small", "major")], "ref_no bigint, entry_no bigint, text string, severity string")
    tool = spark.createDataFrame([("m", 2, 5, "control missing")], "model string, entry_no bigint, tool_no bigint, text string")
    e = match.jaccard_edges(tool, ref)
    c = {r.entry_no: r for r in metrics.article_counts(articles, tool.select("model"), tool, ref, match.greedy_matches(e, 0.1)).collect()}
    assert (c[1].n_ref, c[1].n_tool, c[2].n_ref, c[2].n_tool) == (1, 0, 0, 1)
    m = metrics.micro(metrics.article_counts(articles, tool.select("model"), tool, ref, match.greedy_matches(e, 0.1)), "model").first()
    assert (m.recall, m.precision, m.f1) == (0.0, 0.0, 0.0)


def test_thresholds_and_configuration():
    assert match.effective_threshold(0.65, "jaccard") == pytest.approx(0.195)
    with pytest.raises(ValueError):
        match.MatcherConfig(backend="guess").validate()


def test_deduplication_keeps_the_first(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], "g int, n bigint, embedding array<float>")
    assert sorted(r.n for r in match.deduplicated(v, "g", "n").collect()) == [0, 2, 3]


def test_average_rank_of_ties(spark):
    d = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "m string, s int")
    assert {r.m: r["rank"] for r in d.select("m", match.average_rank([F.lit(1)], F.col("s")).alias("rank")).collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}
