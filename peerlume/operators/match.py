"""Score edges between predicted and reference concerns, and one-to-one matchings of them.

Edges exist inside an article only, so the join key is the article and never the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlume.functions.text import jaccard, match_tokens

# Default threshold for embeddings, and what Jaccard makes of it.
EMBEDDING_THRESHOLD = 0.65
JACCARD_FACTOR = 0.3
EDGE = ["model", "entry_no", "tool_no", "ref_no"]


@dataclass(frozen=True)
class MatcherConfig:
    """How concerns are scored and matched; ``validate`` refuses what cannot be computed."""

    threshold: float = EMBEDDING_THRESHOLD
    backend: str = "jaccard"
    algorithm: str = "hungarian"
    exclude_figure: bool = True
    dedup_reference: bool = False

    def validate(self) -> MatcherConfig:
        if self.backend not in ("jaccard", "embedding"):
            raise ValueError(f"unknown backend {self.backend!r}")
        if self.algorithm not in ("greedy", "hungarian"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")
        return self

    @property
    def effective_threshold(self) -> float:
        return effective_threshold(self.threshold, self.backend)


def effective_threshold(threshold: float, backend: str) -> float:
    """Threshold on the scale of the backend."""
    return threshold * JACCARD_FACTOR if backend == "jaccard" else threshold


def scorable(concerns: DataFrame, exclude_figure: bool = True) -> DataFrame:
    """Reference concerns that count; a missing figure flag is no figure."""
    return concerns.where(~F.coalesce("requires_figure_reading", F.lit(False))) if exclude_figure else concerns


def jaccard_edges(tool: DataFrame, ref: DataFrame) -> DataFrame:
    """(model, entry_no, tool_no, ref_no, score) for every pair inside an article; tokens are made once per concern."""
    t = tool.select("model", "entry_no", "tool_no", match_tokens(F.col("text")).alias("tt"))
    r = ref.select("entry_no", "ref_no", match_tokens(F.col("text")).alias("rt"))
    return t.join(r, "entry_no").select(*EDGE, jaccard("tt", "rt").alias("score"))


def cosine_edges(tool: DataFrame, ref: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """As :func:`jaccard_edges` for unit vectors: the score is their dot product."""
    dot = F.aggregate(F.zip_with("tv", "rv", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    t = tool.select(key, "tool_no", F.col(vector).alias("tv"))
    r = ref.select(key, "ref_no", F.col(vector).alias("rv"))
    return t.join(r, key).select(key, "tool_no", "ref_no", dot.alias("score"))


def greedy_matches(edges: DataFrame, threshold: float, group: tuple[str, ...] = ("model", "entry_no")) -> DataFrame:
    """One-to-one edges, best first: by score, tool and reference number, all descending.

    A fold over the sorted edges of a group; only edges at the threshold or above are gathered.
    """
    edge = F.struct("score", "tool_no", "ref_no")
    kind = "array<struct<score:double,tool_no:bigint,ref_no:bigint>>"
    took = lambda acc, e: F.exists(acc, lambda x: (x["tool_no"] == e["tool_no"]) | (x["ref_no"] == e["ref_no"]))
    chosen = F.aggregate(
        F.sort_array(F.collect_list(edge), asc=False).cast(kind),
        F.array().cast(kind),
        lambda acc, e: F.when(took(acc, e), acc).otherwise(F.concat(acc, F.array(e))),
    )
    good = edges.where(F.col("score") >= threshold)
    return good.groupBy(*group).agg(chosen.alias("m")).select(*group, F.explode("m").alias("m")).select(*group, "m.tool_no", "m.ref_no", "m.score")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a minimum-cost assignment (shortest augmenting paths with potentials)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        shortest, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, col, dist = row, -1, 0.0
        while True:
            reduced = dist + c[i] - u[i] - v
            better = ~done & (reduced < shortest)
            shortest[better], before[better] = reduced[better], col
            col = int(np.where(done, np.inf, shortest).argmin())
            dist = float(shortest[col])
            done[col] = True
            if owner[col] < 0:
                break
            i = int(owner[col])
        u[row] += dist
        for k in np.flatnonzero(done):
            if owner[k] >= 0 and k != col:
                u[owner[k]] += dist - shortest[k]
            v[k] -= dist - shortest[k]
        while col >= 0:
            prev = int(before[col])
            owner[col] = owner[prev] if prev >= 0 else row
            col = prev
    pairs = [(int(r), k) for k, r in enumerate(owner) if r >= 0]
    return [(b, a) for a, b in pairs] if flip else pairs


def hungarian_matches(edges: DataFrame, threshold: float, group: tuple[str, ...] = ("model", "entry_no")) -> DataFrame:
    """One-to-one edges of the largest number and, among those, the largest total score.

    Edges whose concerns have no other edge are matched natively. Spark has no assignment operator
    for the rest: they are gathered per group and solved in Arrow batches of many groups.
    """
    kinds = dict(edges.dtypes)
    good = edges.where(F.col("score") >= threshold).select(*group, "tool_no", "ref_no", "score")
    gathered = good.groupBy(*group).agg(*[F.collect_list(c).alias(c) for c in ("tool_no", "ref_no", "score")])
    simple = (F.size("tool_no") == F.size(F.array_distinct("tool_no"))) & (F.size("ref_no") == F.size(F.array_distinct("ref_no")))
    alone = gathered.where(simple).select(*group, F.explode(F.arrays_zip("tool_no", "ref_no", "score")).alias("e")).select(*group, "e.*")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, tools, refs, scores in b.itertuples(index=False, name=None):
                t, ti = np.unique(tools, return_inverse=True)
                r, ri = np.unique(refs, return_inverse=True)
                score = np.full((len(t), len(r)), -1.0)
                score[ti, ri] = scores
                cost = np.where(score >= threshold, 1.0 - score, 2.0 * (min(score.shape) + 1))
                rows += [(*key, t[i], r[j], score[i, j]) for i, j in assignment(cost) if score[i, j] >= threshold]
            yield pd.DataFrame(rows, columns=[*group, "tool_no", "ref_no", "score"])

    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + f", tool_no {kinds['tool_no']}, ref_no {kinds['ref_no']}, score double"
    return alone.unionByName(gathered.where(~simple).mapInPandas(solve, schema))


def matches(edges: DataFrame, config: MatcherConfig) -> DataFrame:
    """The matching that the configuration asks for."""
    f = greedy_matches if config.validate().algorithm == "greedy" else hungarian_matches
    return f(edges, config.effective_threshold)


def deduplicated(vectors: DataFrame, group: str, number: str, vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Rows kept when later near-duplicates of a kept earlier row are dropped, in order of ``number`` inside a group."""
    item = F.struct(F.col(number).alias("n"), F.col(vector).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    kind = f"array<struct<n:bigint,v:{dict(vectors.dtypes)[vector]}>>"
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)).cast(kind),
        F.array().cast(kind),
        lambda acc, e: F.when(F.exists(acc, lambda x: dot(x["v"], e["v"]) >= threshold), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return vectors.groupBy(group).agg(F.transform(kept, lambda x: x["n"]).alias("n")).select(group, F.explode("n").alias(number))


def nearest(edges: DataFrame, side: str, group: tuple[str, ...] = ("model", "entry_no")) -> DataFrame:
    """Best edge of each ``tool_no`` or ``ref_no``; ties go to the lowest number on the other side."""
    other = "ref_no" if side == "tool_no" else "tool_no"
    best = F.max_by(F.struct(other, "score"), F.struct("score", -F.col(other)))
    return edges.groupBy(*group, side).agg(best.alias("b")).select(*group, side, F.col(f"b.{other}").alias("nearest"), F.col("b.score").alias("nearest_score"))


def average_rank(by: list[Column], order: Column) -> Column:
    """Rank in descending order where ties share their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order.desc())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / 2
