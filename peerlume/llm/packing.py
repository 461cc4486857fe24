"""Filling containers of fixed capacity with items of varying length.

Items wait in one queue per source. Window after window (a window is a container) is filled by
deficit round-robin: every source earns its target share of the window's capacity, the source with
the largest deficit gives the largest item that still fits, and what a source has given too little
or too much is carried into the next window. The corpus is packed in shards of bounded token mass;
each shard starts with the deficits that all shards before it leave, known from sums per shard.

Defined results: an item longer than the capacity is cut into full pieces, each alone in its
container, and a rest that is packed like an item; no other item is cut. Items without tokens
(NULL and empty texts) take no space and lie in the first container of their shard. NULL sources
are the source "~". Ties go to the source named first and to the smaller item number. An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_TOKENS = 4_000_000  # token mass of a shard: a few thousand containers, packed by one task in about a second


def fill_windows(sources: list[str], sizes: list[int], items: list[int], capacity: int, share: dict[str, float], deficit: dict[str, float]) -> np.ndarray:
    """Window of each item. ``deficit`` holds the carried deficits and is updated in place."""
    window = np.full(len(items), 0, dtype=np.int64)
    queues: dict[str, tuple[list[int], list[int]]] = {}
    for k in sorted(range(len(items)), key=lambda k: (sizes[k], -items[k])):
        if sizes[k] > 0:
            queue = queues.setdefault(sources[k], ([], []))
            queue[0].append(sizes[k])
            queue[1].append(k)
    names = sorted(queues)
    smallest = {s: queues[s][0][0] for s in names}
    at = 0
    while names:
        for s in names:
            deficit[s] = deficit.get(s, 0.0) + share.get(s, 0.0) * capacity
        room = capacity
        waiting = list(names)
        while waiting:
            s = max(waiting, key=lambda x: deficit[x])
            ns, ks = queues[s]
            i = bisect_right(ns, room) - 1
            if i < 0:
                waiting.remove(s)
                continue
            size = ns.pop(i)
            window[ks.pop(i)] = at
            room -= size
            deficit[s] -= size
            if not ns:
                waiting.remove(s)
                names.remove(s)
            else:
                smallest[s] = ns[0]
            if room < 1:
                break
        at += 1
    return window


def pack(items: DataFrame, key: str, source: str, size: str, capacities: list[tuple[int, int]], shares: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container_id, bin, key, piece_no, start_token, n_tokens, source) for each of the (container_id, capacity).

    ``shares`` are the target token shares per source, by default those of the corpus. ``items``
    is read several times and should be a written table.
    """
    if not capacities:
        raise ValueError("no capacities")
    spark = items.sparkSession
    items = items.select(F.col(key).alias("item"), F.coalesce(source, F.lit("~")).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    totals = items.groupBy("source").agg(F.sum("size").alias("n"))
    mass = totals.agg(F.sum("n")).first()[0] or 0
    shards = max(1, int(mass // shard_tokens))
    kinds = F.array(*[F.struct(F.lit(i).cast("bigint").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities])
    each = items.select("*", F.explode(kinds).alias("x")).select("item", "source", "size", "x.*")
    full = F.floor(F.col("size") / F.col("capacity"))
    columns = ["container_id", "bin", F.col("item").alias(key), "piece_no", "start_token", "n_tokens", "source"]
    cut = (
        each.where("size >= capacity")
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece_no"))
        .select("*", F.concat_ws(":", F.lit("whole"), "item", "piece_no").alias("bin"), (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
        .select(*columns)
    )
    rest = each.withColumn("n", F.col("size") % F.col("capacity")).where("n > 0 or size = 0")
    rest = rest.select("container_id", "capacity", "item", "source", "n", full.alias("piece_no"), F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
    carried = rest.groupBy("container_id", "shard", "source").agg(F.sum("n").alias("supply"))
    if shares is None:
        wanted = carried.groupBy("container_id", "source").agg(F.sum("supply").alias("n"))
        wanted = wanted.select("container_id", "source", (F.col("n") / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy("container_id")))).alias("share"))
    else:
        wanted = spark.createDataFrame([(i, s, float(x)) for i, _ in capacities for s, x in shares.items()], "container_id bigint, source string, share double")
    # deficits before a shard: what the source should have given so far less what it has had
    mass_of = carried.groupBy("container_id", "shard").agg(F.sum("supply").alias("mass"))
    before = Window.partitionBy("container_id").orderBy("shard")
    mass_of = mass_of.withColumn("mass_before", F.sum("mass").over(before) - F.col("mass"))
    by_source = Window.partitionBy("container_id", "source").orderBy("shard")
    state = (
        carried.withColumn("supply_before", F.sum("supply").over(by_source) - F.col("supply"))
        .join(mass_of, ["container_id", "shard"])
        .join(F.broadcast(wanted) if shares is not None else wanted, ["container_id", "source"], "left")
        .select("container_id", "shard", "source", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("mass_before") - F.col("supply_before")).alias("deficit"))
    )
    ready = rest.join(state, ["container_id", "shard", "source"])

    def run(key_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("item", ignore_index=True)
        per = b.drop_duplicates("source").set_index("source")
        capacity = int(b["capacity"].iloc[0])
        owed = {s: float(d) for s, d in per["deficit"].items()}
        w = fill_windows(b["source"].tolist(), b["n"].tolist(), b["item"].tolist(), capacity, per["share"].to_dict(), owed)
        return pd.DataFrame(
            {
                "container_id": b["container_id"], "bin": [f"{key_[1]}:{x}" for x in w], "item": b["item"], "piece_no": b["piece_no"],
                "start_token": b["piece_no"] * capacity, "n_tokens": b["n"], "source": b["source"],
            }
        )

    packed = ready.groupBy("container_id", "shard").applyInPandas(
        run, f"container_id bigint, bin string, item {dict(items.dtypes)['item']}, piece_no bigint, start_token bigint, n_tokens bigint, source string"
    )
    return packed.select(*columns).unionByName(cut)


def fill_report(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(container_id, capacity, bins, tokens, fill): how full the containers are."""
    capacity = F.create_map(*[F.lit(x).cast("bigint") for pair in capacities for x in pair])
    bins = packed.groupBy("container_id", "bin").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most"))
    return bins.groupBy("container_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).select(
        "container_id", capacity[F.col("container_id")].alias("capacity"), "bins", "tokens", "fullest",
        (F.col("tokens") / (F.col("bins") * capacity[F.col("container_id")])).alias("fill"),
    )


def mixture_report(packed: DataFrame, key: str, source: str = "source") -> DataFrame:
    """(container_id, source, share, windows, mean_off, most_off, most_owed): how the windows follow the mixture.

    share is the source's part of all tokens in shared windows (items that fill windows of their own
    are left out); mean_off and most_off are the mean and the largest distance of its part of a window
    from that share; most_owed is the largest number of tokens that it was behind or ahead at the end
    of a window of its shard. All of it is sums per (window, source) and running sums per shard.
    """
    shared = packed.where(~F.col("bin").startswith("whole:"))
    cells = shared.groupBy("container_id", "bin", source).agg(F.sum("n_tokens").alias("n"))
    cells = cells.withColumns({"shard": F.substring_index("bin", ":", 1).cast("bigint"), "place": F.substring_index("bin", ":", -1).cast("bigint")})
    windows = cells.groupBy("container_id", "bin", "shard", "place").agg(F.sum("n").alias("m")).where("m > 0")
    whole = windows.groupBy("container_id").agg(F.sum("m").alias("whole"), F.count(F.lit(1)).alias("windows"))
    # the containers are few and so are the sources: one row for each of both
    of_source = cells.groupBy("container_id", source).agg(F.sum("n").alias("of_source")).join(F.broadcast(whole), "container_id")
    of_source = F.broadcast(of_source.select("container_id", source, "windows", (F.col("of_source") / F.col("whole")).alias("share")))
    each = windows.join(of_source, "container_id").join(cells.select("container_id", "bin", source, "n"), ["container_id", "bin", source], "left")
    so_far = Window.partitionBy("container_id", "shard", source).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce("n", F.lit(0))
    each = each.withColumn("off", F.abs(n / F.col("m") - F.col("share"))).withColumn("owed", F.abs(F.sum(F.col("share") * F.col("m") - n).over(so_far)))
    return each.groupBy("container_id", source).agg(
        F.first("share").alias("share"), F.first("windows").alias("windows"), F.avg("off").alias("mean_off"), F.max("off").alias("most_off"), F.max("owed").alias("most_owed")
    )


def violations(packed: DataFrame, sizes: DataFrame, key: str, size: str, capacities: list[tuple[int, int]]) -> DataFrame:
    """(container_id, problem, n) of broken promises, none if all is right: overfull windows, items cut
    although they fit, items whose pieces do not add up, and items that are missing."""
    table = F.create_map(*[F.lit(x).cast("bigint") for pair in capacities for x in pair])
    capacity = table[F.col("container_id")]
    full = packed.groupBy("container_id", "bin").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > capacity).select("container_id", F.lit("overfull").alias("problem"))
    ids = F.explode(F.array(*[F.lit(i).cast("bigint") for i, _ in capacities])).alias("container_id")
    # rows of one key are compared as a whole: their tokens and the number of pieces they need
    need = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity))
    wanted = sizes.select(key, F.coalesce(size, F.lit(0)).alias(size), ids).select(key, "container_id", size, need.alias("need"))
    wanted = wanted.groupBy(key, "container_id").agg(F.sum(size).alias("tokens"), F.sum("need").alias("need"))
    got = packed.groupBy(F.col(key).alias("_k"), F.col("container_id").alias("_c")).agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"))
    both = wanted.join(got, F.col(key).eqNullSafe(F.col("_k")) & (F.col("container_id") == F.col("_c")), "left")
    problem = F.when(F.col("pieces").isNull(), "missing").when(F.col("placed") != F.col("tokens"), "tokens").when(F.col("pieces") != F.col("need"), "cut")
    return full.unionByName(both.select("container_id", problem.alias("problem")).where("problem is not null")).groupBy("container_id", "problem").agg(F.count(F.lit(1)).alias("n"))


def source_column(c: Column) -> Column:
    """Name of the queue of a source: lower case, trimmed."""
    return F.lower(F.trim(c))
