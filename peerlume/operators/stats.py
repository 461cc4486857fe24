"""Resampling and rank statistics.

Exact tests enumerate sign or swap patterns inside Spark; sampled versions draw from hashes, so any
engine reproduces them and partial sums combine on the map side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlume.operators.match import average_rank

EXACT_PAIRS = 16  # more informative pairs than this are sampled
DRAWS = 10_000


def _patterns(n: Column) -> Column:
    """2 to the power of n, as a number of patterns."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def sign_flip_exact(pairs: DataFrame, by: list[str], diff: str) -> DataFrame:
    """(by, n, p): share of sign patterns whose absolute sum reaches the observed one; zero differences say nothing.

    For at most EXACT_PAIRS differences a group; p is 1 where all differences are zero.
    """
    g = pairs.groupBy(*by).agg(F.filter(F.collect_list(F.col(diff).cast("double")), lambda d: d != 0).alias("d"))
    g = g.withColumn("n", F.size("d")).withColumn("_ok", F.when(F.col("n") > EXACT_PAIRS, F.raise_error(F.lit("too many pairs for the exact test"))).otherwise(F.lit(True))).where("_ok")
    signed = lambda m: F.aggregate(
        F.sequence(F.lit(0), F.col("n") - 1),
        F.lit(0.0),
        lambda s, i: s + F.when(F.getbit(m, i) == 1, -F.get("d", i)).otherwise(F.get("d", i)),
    )
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x))
    hits = F.size(F.filter(F.sequence(F.lit(0).cast("bigint"), _patterns(F.col("n")) - 1), lambda m: F.abs(signed(m)) >= observed - 1e-12))
    return g.select(*by, "n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(hits / _patterns(F.col("n"))).alias("p"))


def micro_f1_swap_exact(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, p) of the paired randomisation test on micro-F1.

    ``counts`` has matched, tool of two systems (m1, t1, m2, t2) and the common reference count (r)
    per pair; a pattern swaps the two systems in some pairs and recomputes both F1.
    """
    g = counts.groupBy(*by).agg(F.collect_list(F.struct("m1", "t1", "m2", "t2", "r")).alias("x"))
    g = g.withColumn("n", F.size("x")).withColumn("_ok", F.when(F.col("n") > EXACT_PAIRS, F.raise_error(F.lit("too many pairs for the exact test"))).otherwise(F.lit(True))).where("_ok")

    def gap(mask: Column) -> Column:
        pick = lambda i, a, b: F.when(F.getbit(mask, i) == 1, F.get("x", i)[b]).otherwise(F.get("x", i)[a])
        total = lambda a, b: F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda s, i: s + pick(i, a, b))
        r = F.aggregate("x", F.lit(0.0), lambda s, e: s + e["r"])
        f1 = lambda m, t: F.coalesce(F.try_divide(2 * m, r + t), F.lit(0.0))
        return F.abs(f1(total("m1", "m2"), total("t1", "t2")) - f1(total("m2", "m1"), total("t2", "t1")))

    masks = F.sequence(F.lit(0).cast("bigint"), _patterns(F.col("n")) - 1)
    hits = F.size(F.filter(masks, lambda m: gap(m) >= gap(F.lit(0).cast("bigint")) - 1e-12))
    return g.select(*by, "n", (hits / _patterns(F.col("n"))).alias("p"))


def sign_flip_p(diffs: np.ndarray, seed: int = 42, draws: int = DRAWS) -> float | None:
    """p of the paired sign-flip test; sampled beyond EXACT_PAIRS pairs, with one added to both counts."""
    if not len(diffs):
        return None
    d = diffs[diffs != 0]
    if not len(d):
        return 1.0
    observed = abs(d.sum()) - 1e-12
    if len(d) <= EXACT_PAIRS:
        signs = 1 - 2 * ((np.arange(1 << len(d))[:, None] >> np.arange(len(d))) & 1)
        return float((np.abs(signs @ d) >= observed).mean())
    signs = np.random.default_rng(seed).choice([-1, 1], size=(draws, len(d)))
    return float(((np.abs(signs @ d) >= observed).sum() + 1) / (draws + 1))


def poisson_weight(key: Column) -> Column:
    """Weight of a row in one bootstrap replicate: a Poisson(1) draw from the first 32 bits of an MD5."""
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, low, p = F.lit(7), 0.0, float(np.exp(-1))
    steps = []
    for k in range(7):
        low += p
        steps.append((low, k))
        p /= k + 1
    for bound, k in reversed(steps):
        out = F.when(u < bound, F.lit(k)).otherwise(out)
    return out


def bootstrap_ci(counts: DataFrame, by: list[str], unit: str, replicates: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, recall_low, recall_high, precision_low, precision_high) by resampling articles.

    Poisson weights make the bootstrap one pass of partial sums instead of drawing rows; bounds are
    order statistics at int(a/2 B) and int((1 - a/2) B) - 1.
    """
    each = counts.select(*by, unit, "n_ref", "n_tool", "n_matched", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = each.withColumn("w", poisson_weight(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(unit).cast("string"))))
    s = each.groupBy(*by, "replicate").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n_ref", "n_tool", "n_matched")])
    s = s.select(*by, F.coalesce(F.try_divide(F.col("n_matched").cast("double"), F.col("n_ref").cast("double")), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(F.col("n_matched").cast("double"), F.col("n_tool").cast("double")), F.lit(0.0)).alias("precision"))
    low, high = int((1 - level) / 2 * replicates), int((1 - (1 - level) / 2) * replicates) - 1
    at = lambda c, i: F.get(F.array_sort(F.collect_list(c)), i)
    return s.groupBy(*by).agg(*[at(c, i).alias(f"{c}_{n}") for c in ("recall", "precision") for n, i in (("low", low), ("high", high))])


def cluster_bootstrap(pairs: DataFrame, by: list[str], cluster: str, replicates: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, low, high) of the agreement of two raters, resampling whole articles; percentiles are interpolated."""
    per = pairs.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    each = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = each.withColumn("w", poisson_weight(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(cluster).cast("string"))))
    s = each.groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("same")).cast("double"), F.sum(F.col("w") * F.col("n")).cast("double")).alias("agreement"))
    a = (1 - level) / 2
    return s.groupBy(*by).agg(F.percentile("agreement", a).alias("low"), F.percentile("agreement", 1 - a).alias("high"))


def kendall(ranks: DataFrame, item: str, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Kendall's tau-a and tau-b of two scores over all unordered pairs of items (items are few: models, sources)."""
    by = by or []
    a = ranks.select(*by, F.col(item).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    b = ranks.select(*by, F.col(item).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    p = (a.join(b, by) if by else a.join(b, a.i < b.j)).where("i < j")
    s = F.signum(F.col("xi") - F.col("xj")) * F.signum(F.col("yi") - F.col("yj"))
    g = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(s), F.lit(0.0)).alias("score"),
        F.count_if(F.col("xi") == F.col("xj")).alias("ties_x"), F.count_if(F.col("yi") == F.col("yj")).alias("ties_y"),
    )
    root = F.sqrt((F.col("n_pairs") - F.col("ties_x")).cast("double") * (F.col("n_pairs") - F.col("ties_y")))
    return g.select(*by, "n_pairs", F.try_divide(F.col("score"), F.col("n_pairs").cast("double")).alias("tau_a"), F.try_divide(F.col("score"), root).alias("tau_b"))


def wilcoxon(pairs: DataFrame, by: list[str], diff: str) -> DataFrame:
    """Signed-rank sums and the normal approximation's z; ranks come from counts per distinct difference, never from a global sort."""
    d = pairs.where(F.col(diff) != 0).select(*by, F.abs(diff).alias("size"), (F.col(diff) > 0).alias("up"))
    per = d.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("n_up"))
    w = Window.partitionBy(*by)
    per = per.withColumn("rank", F.sum("n").over(w.orderBy("size")) - (F.col("n") - 1) / 2)
    g = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n_up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("n_up"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    return g.select(*by, "n", "w_plus", "w_minus", F.try_divide(F.least("w_plus", "w_minus") - mean, F.sqrt(var)).alias("z"))


def leaderboard(results: DataFrame, order: list[str], keep: Column | None = None) -> DataFrame:
    """Best run per tool and version, ranked 1..n by F1, recall, then load order (there are few tools)."""
    r = results if keep is None else results.where(keep)
    best = Window.partitionBy("tool", "version").orderBy(F.desc("f1"), F.desc("recall"), F.desc("run_date"), *order)
    r = r.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("f1"), F.desc("recall"), *order)))


def homogeneous(results: DataFrame, signature: list[str]) -> DataFrame:
    """``results`` if all runs that matched anything used one matcher, else an error."""
    n = results.where("n_ref > 0 and n_tool > 0").select(*signature).distinct().limit(2).count()
    if n > 1:
        raise ValueError(f"runs with different matchers cannot be compared: {', '.join(signature)}")
    return results


def with_average_rank(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds ``rank``: descending, ties share their mean rank."""
    return df.withColumn("rank", average_rank([F.col(b) for b in by] or [F.lit(1)], F.col(score)))


def sign_flip_sampled(pairs: DataFrame, by: list[str], diff: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, n, p) of the sampled sign-flip test, one added to both counts; p is 1 where all differences are zero.

    Pairs enter as counts per size of difference, and a draw takes one bit of a hash per pair, 32 at
    a time: the sum of a draw is made of bit counts, so no pair meets another and no task holds more
    than partial sums.
    """
    of = F.col(diff)
    sizes = pairs.groupBy(*by, F.abs(of).alias("size")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.signum(of)).alias("signs"))
    total = sizes.groupBy(*by).agg(F.sum(F.when(F.col("size") != 0, F.col("pairs")).otherwise(0)).alias("n"), F.abs(F.sum(F.col("size") * F.col("signs"))).alias("observed"))
    words = sizes.where("size <> 0").select(*by, "size", "pairs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("pairs") - 1) / 32))).alias("word"))
    words = words.withColumn("bits", F.least(F.lit(32), F.col("pairs") - 32 * F.col("word")))
    each = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", F.col("size").cast("string"), "word")), 1, 8), 16, 10).cast("bigint")
    plus = F.bit_count(drawn.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits").cast("int")) - 1))
    sums = each.groupBy(*by, "draw").agg(F.abs(F.sum(F.col("size") * (2 * plus - F.col("bits")))).alias("reached"))
    same = [F.col(f"t.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    met = total.alias("t").join(sums.alias("s"), same, "left")  # as many rows as draws a comparison
    hits = F.count_if(F.col("reached") >= F.col("observed") - 1e-12)
    out = met.groupBy(*[F.col(f"t.{b}").alias(b) for b in by]).agg(F.first("n").alias("n"), hits.alias("hits"))
    return out.select(*by, "n", F.when(F.col("n") == 0, F.lit(1.0)).otherwise((F.col("hits") + 1) / F.lit(draws + 1.0)).alias("p"))


def model_pairs(scores: DataFrame, model: str, unit: str, score: str) -> DataFrame:
    """(model_a, model_b, n, a_wins, b_wins, ties, mean_difference) of all unordered pairs of models on their common units; models are few."""
    a = scores.select(F.col(model).alias("model_a"), unit, F.col(score).alias("x"))
    b = scores.select(F.col(model).alias("model_b"), unit, F.col(score).alias("y"))
    p = a.join(b, unit).where("model_a < model_b")
    count = lambda c, name: F.count_if(c).alias(name)
    return p.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("x") > F.col("y"), "a_wins"), count(F.col("x") < F.col("y"), "b_wins"), count(F.col("x") == F.col("y"), "ties"), F.avg(F.col("x") - F.col("y")).alias("mean_difference")
    )


def renumbered(ranking: DataFrame, rank: str, name: str) -> DataFrame:
    """An imported ranking with ranks 1..n in the order of the stored ones (a ranking is a handful of rows)."""
    return ranking.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rank, name)))
