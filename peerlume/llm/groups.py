"""Splits that keep related records together.

Records and the entities they name (manuscripts, by id or DOI) form a bipartite graph; minimum
labels travel over it until they stand still, then whole groups are dealt to the splits.

Defined results: a record without any entity is a group of its own; repeated rows are separate
records of one group; an empty table gives an empty result; extra columns are ignored; NULL
strata count as the value "~".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlume.session import cut

MAX_ROUNDS = 60  # labels reach the end of a chain of n records in about log2(n) rounds


def minimum_labels(edges: DataFrame) -> DataFrame:
    """(record, key) edges -> (key, label): the smallest record number that each key is connected to.

    One round: record = least label of its keys, key = least label of its records, then a pointer
    jump (label of the label), so that long chains need logarithmically many rounds. Only keys on
    records with two keys or more take part; all others have their label at once.
    """
    start = edges.groupBy("key").agg(F.min("record").alias("start"))
    several = edges.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
    bridge = cut(edges.join(several, "record", "left_semi"))
    labels = cut(bridge.select("key").distinct().join(start, "key").select("key", "start", F.col("start").alias("label")))
    for _ in range(MAX_ROUNDS):
        of_record = bridge.join(labels, "key").groupBy("record").agg(F.min("label").alias("label"))
        of_key = bridge.join(of_record, "record").groupBy("key").agg(F.min("label").alias("near"))
        step = labels.join(of_key, "key").select("key", "start", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.groupBy("start").agg(F.min("label").alias("to")).withColumnRenamed("start", "label")
        labels = cut(step.join(jump, "label", "left").select("key", "start", "old", F.least("label", "to").alias("label")))
        moved = labels.where("label < old").limit(1).count()
        labels = labels.select("key", "start", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
    done = labels.select("key", F.col("label").alias("moved"))
    return start.join(done, "key", "left").select("key", F.coalesce("moved", "start").alias("label"))


def related_groups(df: DataFrame, record: Column, entities: list[Column]) -> DataFrame:
    """(record_no, group_no) for each row; group_no is the smallest record_no of the group.

    Rows that name the same entities are one node of the graph, so a manuscript that is listed a
    million times costs one edge; the number of rows of one entity never meets in one task.
    """
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array(*entities))))
    rows = df.select(record.alias("record_no"), keys.alias("keys"))
    named = rows.where(F.size("keys") > 0).groupBy("keys").agg(F.min("record_no").alias("record"))
    edges = named.select("record", F.explode("keys").alias("key"))
    labels = minimum_labels(edges)
    alone = rows.where(F.size("keys") == 0).select("record_no", F.col("record_no").alias("group_no"))
    return rows.where(F.size("keys") > 0).withColumn("key", F.get("keys", F.lit(0))).join(labels, "key").select("record_no", F.col("label").alias("group_no")).unionByName(alone)


def with_relatives(groups: DataFrame) -> DataFrame:
    """Rows of groups of two rows or more."""
    several = groups.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_no")
    return groups.join(several, "group_no", "left_semi").select("record_no", "group_no")


MOST_STRATA = 200  # largest strata that the placement of large groups looks at one by one; it takes the rest as one
LARGE_SHARE = 1000  # a group of at least 1/1000 of all rows is placed alone, so there are at most 1000 of them
ROWS_A_BUCKET = 50_000
GOLDEN = 0.6180339887498949  # multiples of it fill [0, 1) evenly from any start on


def assign_splits(rows: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(record_no, group_no, stratum) -> (record_no, group_no, split), whole groups kept together.

    Large groups (at most 1000 by definition) are placed one by one where the label distribution
    of the splits deviates least. All others are ordered by what they consist of (their rows per
    stratum) and dealt evenly along this order, each with the chances that its strata have left in
    the splits; so groups alike in size and strata, mixed ones as well, spread over the splits in
    the proportions wanted, at every size of the input. Places in the order are made in two steps
    (buckets, then inside a bucket), so that a stratum with a third of all rows is no single task.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("stratum", F.coalesce("stratum", F.lit("~")))
    per = cut(rows.groupBy("group_no", "stratum").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(per.groupBy("stratum").agg(F.sum("n").alias("n")))
    kept = {r.stratum: r.n for r in sizes.orderBy(F.desc("n"), "stratum").limit(MOST_STRATA).collect()}
    rows_in_all = sizes.agg(F.sum("n")).first()[0] or 0
    names = [name for name, _ in targets]
    share = {name: pct / sum(p for _, p in targets) for name, pct in targets}
    totals = {**kept, None: rows_in_all - sum(kept.values())}  # None is what the placement takes as one stratum
    least = max(2, -(-rows_in_all // LARGE_SHARE))
    large = per.groupBy("group_no").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    known = F.when(F.col("stratum").isin(list(kept)), F.col("stratum")) if kept else F.lit(None).cast("string")
    held = {(s, t): 0 for s in names for t in totals}
    placed: list[tuple[int, str]] = []
    by_group: dict[int, dict[str | None, int]] = {}
    for r in per.join(F.broadcast(large), "group_no").groupBy("group_no", known.alias("stratum")).agg(F.sum("n").alias("n")).collect():  # at most LARGE_SHARE groups x strata
        by_group.setdefault(r.group_no, {})[r.stratum] = r.n
    for no, has in sorted(by_group.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        cost = {s: sum((held[s, t] + n - share[s] * totals[t]) ** 2 - (held[s, t] - share[s] * totals[t]) ** 2 for t, n in has.items()) for s in names}
        best = min(names, key=lambda s: (cost[s] / share[s] if share[s] else float("inf"), s))
        placed.append((no, best))
        for t, n in has.items():
            held[best, t] += n
    alone = spark.createDataFrame(placed or [(None, None)], "group_no bigint, split string").where("group_no is not null")

    # chances of a stratum: what it still lacks in each split
    chances = []
    for t in totals:
        left = [max(0.0, share[s] * totals[t] - held[s, t]) for s in names]
        chances.append((t, [x / sum(left) if sum(left) else share[s] for x, s in zip(left, names)]))
    table = spark.createDataFrame(chances, "of string, chance array<double>")  # at most MOST_STRATA + 1 rows
    rest = per.join(F.broadcast(alone.select("group_no")), "group_no", "left_anti").withColumn("known", known)
    rest = rest.join(F.broadcast(table), F.col("known").eqNullSafe(F.col("of"))).select("group_no", "stratum", "n", "chance")
    groups = rest.groupBy("group_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stratum", "n"))), lambda x: F.concat_ws(":", x["stratum"], x["n"])), ";").alias("consists"),
        F.max_by("stratum", F.struct("n", "stratum")).alias("most"),
        *[(F.sum(F.col("n") * F.col("chance")[i]) / F.sum("n")).alias(f"c{i}") for i in range(len(names))],
    )
    buckets = max(1, rows_in_all // ROWS_A_BUCKET)
    groups = cut(groups.withColumn("consists", F.md5("consists")).withColumn("bucket", F.pmod(F.xxhash64("group_no"), F.lit(buckets))))
    before = Window.partitionBy("most").orderBy("consists", "bucket")
    cells = groups.groupBy("most", "consists", "bucket").agg(F.count(F.lit(1)).alias("k"))
    cells = cells.select("most", "consists", "bucket", (F.sum("k").over(before) - F.col("k")).alias("start"))
    inside = Window.partitionBy("most", "consists", "bucket").orderBy(F.xxhash64("group_no", F.lit(7)), "group_no")
    at = F.col("start") + F.row_number().over(inside)
    point = (at * F.lit(GOLDEN) + F.pmod(F.xxhash64("most"), F.lit(1 << 20)) / F.lit(float(1 << 20))) % 1
    dealt = groups.join(cells, ["most", "consists", "bucket"]).withColumn("u", point)
    split = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        split = F.when(F.col("u") < sum((F.col(f"c{j}") for j in range(1, i + 1)), F.col("c0")), F.lit(names[i])).otherwise(split)
    dealt = dealt.select("group_no", split.alias("split"))
    return rows.join(alone.unionByName(dealt), "group_no").select("record_no", "group_no", "split")
