"""Counts and scores of matched concerns, from articles up to models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlume.functions.text import f_score, ratio
from peerlume.operators.match import nearest

ARTICLE = ["model", "entry_no"]


def article_counts(articles: DataFrame, models: DataFrame, tool: DataFrame, ref: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per model and article: n_ref, n_tool, n_matched and the same by severity.

    Every article counts for every model: a model without output for an article missed all of its
    concerns, and predictions for an article without reference concerns still count as predictions.
    ``models`` is a handful of names.
    """
    names = F.array(*[F.lit(r.model) for r in models.select("model").distinct().collect()])
    base = articles.select("entry_no", F.explode(names).alias("model"))
    is_ = lambda s: F.coalesce(F.col("severity") == s, F.lit(False)).cast("int")
    r = ref.groupBy("entry_no").agg(
        F.count(F.lit(1)).alias("n_ref"), F.sum(is_("major")).alias("n_ref_major"), F.sum(is_("minor")).alias("n_ref_minor")
    )
    t = tool.groupBy(*ARTICLE).agg(F.count(F.lit(1)).alias("n_tool"))
    m = matched.join(ref.select("ref_no", "severity"), "ref_no").groupBy(*ARTICLE).agg(
        F.count(F.lit(1)).alias("n_matched"), F.sum(is_("major")).alias("n_matched_major"), F.sum(is_("minor")).alias("n_matched_minor")
    )
    out = base.join(r, "entry_no", "left").join(t, ARTICLE, "left").join(m, ARTICLE, "left")
    counts = ["n_ref", "n_tool", "n_matched", "n_ref_major", "n_ref_minor", "n_matched_major", "n_matched_minor"]
    return out.select(*ARTICLE, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def scores(n_matched: Column, n_ref: Column, n_tool: Column) -> list[Column]:
    """recall, precision and f1 columns."""
    r, p = ratio(n_matched, n_ref), ratio(n_matched, n_tool)
    return [r.alias("recall"), p.alias("precision"), f_score(p, r).alias("f1")]


def micro(counts: DataFrame, *by: str) -> DataFrame:
    """Summed counts per group and their scores."""
    names = [c for c in counts.columns if c.startswith("n_")]
    out = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_articles"), *[F.sum(c).alias(c) for c in names])
    return out.select("*", *scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))


def severity_recall(counts: DataFrame, *by: str) -> DataFrame:
    """Recall of major and of minor concerns; optional ones count in the totals only."""
    m = micro(counts, *by)
    return m.select(
        *by, "n_ref_major", "n_matched_major", "n_ref_minor", "n_matched_minor",
        ratio(F.col("n_matched_major"), F.col("n_ref_major")).alias("recall_major"), ratio(F.col("n_matched_minor"), F.col("n_ref_minor")).alias("recall_minor"),
    )


def soft_metrics(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(model, soft_recall, soft_precision): means over articles of mean best scores; articles without credit count as 0."""
    by_ref = nearest(edges, "ref_no").groupBy(*ARTICLE).agg(F.sum("nearest_score").alias("ref_credit"))
    by_tool = nearest(edges, "tool_no").groupBy(*ARTICLE).agg(F.sum("nearest_score").alias("tool_credit"))
    joined = counts.join(by_ref, ARTICLE, "left").join(by_tool, ARTICLE, "left")
    r, p = ratio(F.coalesce("ref_credit", F.lit(0.0)), F.col("n_ref")), ratio(F.coalesce("tool_credit", F.lit(0.0)), F.col("n_tool"))
    return joined.groupBy("model").agg(F.avg(r).alias("soft_recall"), F.avg(p).alias("soft_precision"), F.count(F.lit(1)).alias("n_articles"))


def category_counts(ref: DataFrame, tool: DataFrame, edges: DataFrame, matched: DataFrame) -> DataFrame:
    """(model, category, n_ref, n_tool, n_matched, ...).

    A predicted concern counts for the category of the reference concern it was matched with, else
    of the most similar one of its article, however low the score; categories come from reference
    concerns, so predictions of articles without any count nowhere.
    """
    kind = ref.select("ref_no", F.coalesce("category", F.lit("other")).alias("category"))
    models = [r.model for r in tool.select("model").distinct().collect()]
    n_ref = kind.groupBy("category").agg(F.count(F.lit(1)).alias("n_ref")).select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    hit = matched.join(kind, "ref_no").groupBy("model", "category").agg(F.count(F.lit(1)).alias("n_matched"))
    free = nearest(edges, "tool_no").join(matched.select("model", "entry_no", "tool_no"), ["model", "entry_no", "tool_no"], "left_anti")
    near = free.join(kind, free.nearest == kind.ref_no).groupBy("model", "category").agg(F.count(F.lit(1)).alias("n_near"))
    out = n_ref.join(hit, ["model", "category"], "left").join(near, ["model", "category"], "left").na.fill(0, ["n_matched", "n_near"])
    out = out.select("model", "category", "n_ref", (F.col("n_matched") + F.col("n_near")).alias("n_tool"), "n_matched")
    return out.select("*", *scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))


def macro_f1(per_category: DataFrame) -> DataFrame:
    """Unweighted mean of the categories' F1 per model."""
    return per_category.groupBy("model").agg(F.count(F.lit(1)).alias("n_categories"), F.avg("f1").alias("macro_f1"))


def threshold_sweep(edges: DataFrame, counts: DataFrame, thresholds: list[float], match) -> DataFrame:
    """Micro scores per model and threshold. Pairs are scored once; the threshold joins the matching's key."""
    marks = sorted(set(thresholds))
    if not marks or not all(0 <= t <= 1 for t in marks):
        raise ValueError("thresholds must lie in [0, 1]")
    many = edges.where(F.col("score") >= marks[0]).select("*", F.explode(F.filter(F.array(*[F.lit(t) for t in marks]), lambda t: t <= F.col("score"))).alias("threshold"))
    matched = match(many, marks[0], ("threshold", "model", "entry_no")).groupBy("model", "threshold").agg(F.count(F.lit(1)).alias("n_matched"))
    totals = counts.groupBy("model").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_tool").alias("n_tool"))
    grid = totals.select("*", F.explode(F.array(*[F.lit(t) for t in marks])).alias("threshold"))
    out = grid.join(matched, ["model", "threshold"], "left").na.fill(0, ["n_matched"])
    return out.select("model", "threshold", "n_ref", "n_tool", "n_matched", *scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))


def auc_pr(sweep: DataFrame) -> DataFrame:
    """Area under precision over recall by trapezoids, in order of recall (ties by threshold), and the best F1."""
    points = F.array_sort(F.collect_list(F.struct("recall", "threshold", "precision")))
    step = lambda acc, x: F.struct(
        (acc["area"] + F.when(acc["n"] > 0, (x["recall"] - acc["r"]) * (x["precision"] + acc["p"]) / 2).otherwise(0.0)).alias("area"),
        x["recall"].alias("r"), x["precision"].alias("p"), (acc["n"] + 1).alias("n"),
    )
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("r"), F.lit(0.0).alias("p"), F.lit(0).alias("n"))
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return sweep.groupBy("model").agg(F.aggregate(points, zero, step, lambda a: a["area"]).alias("auc_pr"), F.max("f1").alias("best_f1"), best.alias("best_threshold"))
