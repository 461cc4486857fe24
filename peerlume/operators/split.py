"""Splits and stratified samples.

Membership goes by the order of ``md5(seed:id)``, which any engine reproduces; quotas are per
stratum. Positions inside a stratum are found from counts per hash bucket first, so that a stratum
with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    """Order key of a row: equal in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def position(df: DataFrame, strata: list[str], order: str, ties: str) -> DataFrame:
    """Adds ``pos`` (1-based, in order of ``order`` then ``ties`` inside a stratum) and ``size`` (rows of the stratum)."""
    b = F.substring(order, 1, 2)
    keyed = df.withColumn("_b", b)
    count = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata)
    count = count.select(*strata, "_b", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("size"))
    inside = Window.partitionBy(*strata, "_b").orderBy(order, ties)
    nulls = [F.col(f"k.{s}").eqNullSafe(F.col(f"c.{s}")) for s in strata]
    cond = F.col("k._b") == F.col("c._b")
    for n in nulls:
        cond = cond & n
    ranked = keyed.withColumn("_i", F.row_number().over(inside)).alias("k").join(F.broadcast(count.alias("c")), cond)  # 256 rows a stratum
    return ranked.select("k.*", (F.col("c._before") + F.col("k._i")).alias("pos"), F.col("c.size").alias("size")).drop("_b", "_i")


def quota(size: Column, share: float) -> Column:
    """Rows of a stratum for a share: at least one, halves to even."""
    return F.greatest(F.lit(1), F.bround(size * share, 0).cast("bigint"))


def stratified_split(df: DataFrame, key: str, strata: list[str], val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): strata of fewer than three rows go to train whole; test comes first in hash order, then val."""
    p = position(df.withColumn("_o", hash_order(F.col(key), seed)), strata, "_o", key)
    n_test, n_val = quota(F.col("size"), test), quota(F.col("size"), val)
    split = F.when(F.col("size") < 3, "train").when(F.col("pos") <= n_test, "test").when(F.col("pos") <= n_test + n_val, "val").otherwise("train")
    return p.select(key, split.alias("split"))


def frozen_split(df: DataFrame, key: str, strata: list[str], frozen: DataFrame, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split) with a fixed test set; val is drawn from the rest of each stratum of two rows or more."""
    ids = frozen.select(key).distinct()
    test = df.join(ids, key, "left_semi").select(key, F.lit("test").alias("split"))
    p = position(df.join(ids, key, "left_anti").withColumn("_o", hash_order(F.col(key), seed)), strata, "_o", key)
    split = F.when((F.col("size") >= 2) & (F.col("pos") <= quota(F.col("size"), val)), "val").otherwise("train")
    return test.unionByName(p.select(key, split.alias("split")))


def balanced_test(df: DataFrame, key: str, source: str, quotas: dict[str, int], val: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, split): exactly min(quota, available) test rows per source, then val by share of what is left."""
    want = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    p = position(df.withColumn("_o", hash_order(F.col(key), seed)), [source], "_o", key)
    n_test = F.least(F.coalesce(want[F.col(source)], F.lit(0)), F.col("size"))
    left = F.col("size") - n_test
    n_val = F.when(left >= 2, quota(left, val)).otherwise(0)
    split = F.when(F.col("pos") <= n_test, "test").when(F.col("pos") <= n_test + n_val, "val").otherwise("train")
    return p.select(key, split.alias("split"))


def largest_remainder(df: DataFrame, key: str, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """(key, strata...): n rows with one per stratum at least and the rest by largest remainder (ties: later strata first).

    With fewer places than strata the largest strata get one each; allocation runs on counts.
    """
    p = position(df.withColumn("_o", hash_order(F.col(key), seed)), strata, "_o", key)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    name = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("~")) for s in strata])
    everyone = Window.partitionBy(F.lit(1))  # one row per stratum
    a = sizes.withColumn("name", name).withColumn("k", F.count(F.lit(1)).over(everyone)).withColumn("pool", F.sum(F.col("size") - 1).over(everyone))
    share = F.coalesce(F.try_divide((F.lit(n) - F.col("k")) * (F.col("size") - 1).cast("double"), F.col("pool").cast("double")), F.lit(0.0))
    a = a.withColumn("share", F.when(F.col("k") <= n, share).otherwise(0.0)).withColumn("extra", F.least(F.floor("share"), F.col("size") - 1))
    a = a.withColumn("used", F.sum(F.col("extra") + 1).over(everyone)).withColumn("frac", F.col("share") - F.floor("share"))
    more = F.row_number().over(everyone.orderBy((F.col("size") > F.col("extra") + 1).desc(), F.desc("frac"), F.desc("name")))
    first = F.row_number().over(everyone.orderBy(F.desc("size"), "name"))
    a = a.withColumn("more", more).withColumn("first", first)
    got = F.when(F.col("k") > n, (F.col("first") <= n).cast("int")).otherwise(
        F.col("extra") + 1 + ((F.col("more") <= F.lit(n) - F.col("used")) & (F.col("size") > F.col("extra") + 1)).cast("int")
    )
    a = a.select(*[F.col(s).alias(f"_{s}") for s in strata], got.alias("got"))
    cond = F.lit(True)
    for s in strata:
        cond = cond & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return p.join(F.broadcast(a), cond).where("pos <= got").select(key, *strata)


def coverage_allocation(sizes: dict[tuple[str, ...], int], n: int) -> dict[tuple[str, ...], int]:
    """Places per stratum of a rater pack; runs on the driver over stratum counts.

    Fewer places than strata: one each where the values seen so far are rarest. Otherwise one
    each, then one by one where the deficit to the proportional target is largest.
    """
    got = dict.fromkeys(sizes, 0)
    keys = sorted(sizes)
    if n < len(keys):
        seen = [Counter() for _ in keys[0]] if keys else []
        left = set(keys)
        for _ in range(n):
            best = min(left, key=lambda k: (-sum(1 / (1 + seen[i][v]) for i, v in enumerate(k)), -sizes[k], k))
            got[best] = 1
            left.remove(best)
            for i, v in enumerate(best):
                seen[i][v] += 1
        return got
    total = sum(sizes.values())
    for k in keys:
        got[k] = 1
    for _ in range(min(n, total) - len(keys)):
        best = min((k for k in keys if got[k] < sizes[k]), key=lambda k: (-(n * sizes[k] / total - got[k]), -(sizes[k] - got[k]), k))
        got[best] += 1
    return got


def pack_sample(df: DataFrame, key: str, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """(key, strata...) by :func:`coverage_allocation`; rows inside a stratum in hash order."""
    filled = df.withColumns({s: F.coalesce(F.col(s).cast("string"), F.lit("~")) for s in strata})
    sizes = {tuple(r[s] for s in strata): r["count"] for r in filled.groupBy(*strata).count().collect()}  # one row per stratum
    got = [(*k, v) for k, v in coverage_allocation(sizes, n).items()]
    table = df.sparkSession.createDataFrame(got or [("",) * len(strata) + (0,)], ", ".join(f"{s} string" for s in strata) + ", got int")
    p = position(filled.withColumn("_o", hash_order(F.col(key), seed)), strata, "_o", key)
    return p.join(F.broadcast(table), strata).where("pos <= got").select(key, *strata)


def error_sample_quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Proportional places per kind of error, one each at least, trimmed to n from the largest."""
    total = sum(sizes.values())
    got = {k: min(v, max(1, round(n * v / total))) for k, v in sizes.items()} if total else {}
    while sum(got.values()) > n:
        got[max(got, key=lambda k: (got[k], k))] -= 1
    for k in sorted(sizes, key=lambda k: (-(sizes[k] - got[k]), k)):
        got[k] += max(0, min(sizes[k] - got[k], n - sum(got.values())))
    return got


def even_sample(df: DataFrame, key: str, group: str, limit: int, seed: int = 42) -> DataFrame:
    """(key, group): ``limit`` rows spread evenly over the groups, the first groups in order of name taking one more; in hash order."""
    names = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(limit).collect()]  # at most limit names
    each, more = divmod(limit, len(names)) if names else (0, 0)
    places = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, each + (i < more))]) if names else F.lit(None)
    p = position(df.where(F.col(group).isin(names)).withColumn("_o", hash_order(F.col(key), seed)), [group], "_o", key)
    return p.where(F.col("pos") <= places[F.col(group)]).select(key, group) if names else df.select(key, group).where("false")


def manual_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order; the limit keeps n rows a task, so nothing is sorted as a whole."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def error_sample(df: DataFrame, key: str, kind: str, n: int, seed: int = 42) -> DataFrame:
    """(key, kind): n rows by :func:`error_sample_quotas`, in hash order inside a kind of error (there are few)."""
    filled = df.withColumn(kind, F.coalesce(kind, F.lit("unknown")))
    got = error_sample_quotas({r[kind]: r["count"] for r in filled.groupBy(kind).count().collect()}, n)
    if not got:
        return filled.select(key, kind)
    places = F.create_map(*[F.lit(x) for pair in got.items() for x in pair])
    p = position(filled.withColumn("_o", hash_order(F.col(key), seed)), [kind], "_o", key)
    return p.where(F.col("pos") <= places[F.col(kind)]).select(key, kind)


def reference_shuffle_split(ids_by_stratum: dict[str, list[str]], val: float, test: float, seed: int) -> dict[str, str]:
    """The split with Python's own generator instead of hashes, for small sets given in load order."""
    rng, out = random.Random(seed), {}
    for ids in ids_by_stratum.values():
        ids = list(ids)
        rng.shuffle(ids)
        n_test, n_val = (max(1, round(len(ids) * r)) if len(ids) >= 3 else 0 for r in (test, val))
        out.update({x: "test" if i < n_test else "val" if i < n_test + n_val else "train" for i, x in enumerate(ids)})
    return out


def legacy_stratum(concerns: Column, stances: Column, review_format: Column, subjects: Column) -> Column:
    """Older stratum: format, mixture of stances, first subject."""
    n = F.size(stances)
    share = lambda s: F.size(F.filter(stances, lambda x: x == s)) / n
    mix = F.when(share("no_response") >= 0.8, "high_noresp").when(share("conceded") >= 0.3, "high_concede").otherwise("mixed")
    first = F.lower(F.get(subjects, 0))
    subject = F.when(F.coalesce(F.size(subjects), F.lit(0)) < 1, "unknown").when(first.contains("neuro"), "neuro").when(first.contains("cell"), "cell").otherwise("other")
    return F.when(F.coalesce(concerns, F.lit(0)) == 0, F.concat(review_format, F.lit(":no_concerns"))).otherwise(F.concat_ws(":", review_format, mix, subject))


def source_balance(df: DataFrame, source: str, most: float = 0.5) -> DataFrame:
    """(source, n, share, dominant): share of each source, and whether it is more than ``most``."""
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("share", share).withColumn("dominant", F.col("share") > most)


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in load order; combines on the map side, unlike a window."""
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).select(*df.columns)
