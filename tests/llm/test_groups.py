"""Groups are the connected components, splits keep them whole and follow the proportions in every stratum."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from peerlume.llm import groups

TARGETS = [("train", 80.0), ("val", 10.0), ("test", 10.0)]


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for no, *keys in rows:
        for k in keys:
            if k is not None:
                parent[find(("k", k))] = find(no)
    least = {}
    for no, *_ in rows:
        least[find(no)] = min(no, least.get(find(no), no))
    return {no: least[find(no)] for no, *_ in rows}


def test_groups_are_components(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, f"a{rng.randrange(150)}"]), rng.choice([None, f"b{rng.randrange(150)}"])) for i in range(300)]
    rows += [(1000 + i, f"chain{i}", f"chain{i + 1}") for i in range(70)]  # a long chain
    rows += [(2000 + i, "hot", None) for i in range(150)]
    df = spark.createDataFrame(rows, "no bigint, a string, b string")
    got = {r.record_no: r.group_no for r in groups.related_groups(df, F.col("no"), [F.col("a"), F.col("b")]).collect()}
    assert got == components(rows)


def test_splits_follow_the_proportions_in_every_stratum(spark):
    rng = random.Random(3)
    rows, no = [], 0
    for g in range(4000):
        for _ in range(rng.choice([1, 1, 1, 2, 3])):  # mixed groups: every row draws its own stratum
            rows.append((no, g, rng.choice(["x", "x", "y", None])))
            no += 1
    rows += [(no + i, 10**6, "y") for i in range(600)]  # one large group
    got = groups.assign_splits(spark.createDataFrame(rows, "record_no bigint, group_no bigint, stratum string"), TARGETS).collect()
    assert len(got) == len(rows)
    of_group = defaultdict(set)
    for r in got:
        of_group[r.group_no].add(r.split)
    assert all(len(s) == 1 for s in of_group.values())
    stratum = {r[0]: r[2] for r in rows}
    counts = Counter((stratum[r.record_no], r.split) for r in got)
    for t in ("x", "y", None):
        whole = sum(counts[t, s] for s, _ in TARGETS)
        for s, pct in TARGETS:
            assert abs(counts[t, s] / whole - pct / 100) < 0.02, (t, s, counts)


def test_rare_strata_and_empty_tables(spark):
    schema = "record_no bigint, group_no bigint, stratum string"
    rows = [(i, i, f"only-{i}") for i in range(1500)]  # more strata than are looked at one by one
    counts = Counter(r.split for r in groups.assign_splits(spark.createDataFrame(rows, schema), TARGETS).collect())
    assert sum(counts.values()) == 1500 and abs(counts["train"] / 1500 - 0.8) < 0.04 and abs(counts["val"] / 1500 - 0.1) < 0.03
    assert groups.assign_splits(spark.createDataFrame([], schema), TARGETS).count() == 0
