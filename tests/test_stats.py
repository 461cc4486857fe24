import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlume.operators import split, stats


def flip(spark, diffs):
    return stats.sign_flip_exact(spark.createDataFrame([(1, float(d)) for d in diffs], "g int, d double"), ["g"], "d").first().p


def test_sign_flip_closed_forms(spark):
    assert flip(spark, [3, 2, 1]) == 0.25
    assert flip(spark, [0, 0]) == 1.0
    assert stats.sign_flip_p(np.array([3.0, 2, 1])) == 0.25
    assert stats.sign_flip_p(np.array([])) is None
    assert 0 < stats.sign_flip_p(np.arange(1.0, 30)) < 0.01


def test_swap_test_recomputes_f1(spark):
    rows = [(1, 1, 1, 0, 1, 1), (1, 1, 1, 0, 1, 1)]
    d = spark.createDataFrame(rows, "g int, m1 int, t1 int, m2 int, t2 int, r int")
    assert stats.micro_f1_swap_exact(d, ["g"]).first().p == 0.5


def test_kendall_and_wilcoxon(spark):
    d = spark.createDataFrame([("a", 1, 1), ("b", 2, 3), ("c", 3, 2)], "i string, x int, y int")
    assert stats.kendall(d, "i", "x", "y").first().tau_a == pytest.approx(1 / 3)
    w = stats.wilcoxon(spark.createDataFrame([(1, d) for d in (1, 2, -3, 0)], "g int, d int"), ["g"], "d").first()
    assert (w.n, w.w_plus, w.w_minus) == (3, 3.0, 3.0)


def test_poisson_weights_have_mean_one(spark):
    got = spark.range(20000).select(F.avg(stats.poisson_weight(F.col("id").cast("string")))).first()[0]
    assert got == pytest.approx(1, abs=0.03)


def test_coverage_allocation():
    # the largest stratum first, then the one whose values were not seen yet
    assert split.coverage_allocation({("a", "x"): 5, ("b", "y"): 3, ("a", "y"): 9, ("b", "x"): 2}, 2) == {("a", "x"): 0, ("b", "y"): 0, ("a", "y"): 1, ("b", "x"): 1}
    got = split.coverage_allocation({("a",): 8, ("b",): 2}, 5)
    assert got == {("a",): 4, ("b",): 1}
    assert sum(split.error_sample_quotas({"a": 10, "b": 1, "c": 1}, 6).values()) == 6


def test_positions_of_a_hot_stratum(spark):
    d = spark.range(500).select("id", F.lit("s").alias("s"))
    p = split.position(d.withColumn("_o", split.hash_order(F.col("id"))), ["s"], "_o", "id")
    assert sorted(r.pos for r in p.collect()) == list(range(1, 501))


def test_small_strata_stay_in_train_and_splits_are_disjoint(spark):
    d = spark.createDataFrame([(i, "big" if i < 40 else "tiny") for i in range(42)], "id bigint, s string")
    got = {r.id: r.split for r in split.stratified_split(d, "id", ["s"]).collect()}
    assert len(got) == 42 and got[40] == got[41] == "train"
    assert [list(got.values()).count(x) for x in ("test", "val")] == [6, 6]
