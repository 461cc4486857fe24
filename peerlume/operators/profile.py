"""Summaries and distributions of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of a column, NULL as "unknown"."""
    n = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def split_summary(articles: DataFrame, concerns: DataFrame) -> DataFrame:
    """(split, field, value, n): articles, concerns and their distributions, per split and over all (NULL)."""
    a = articles.select("split", F.explode(F.create_map(F.lit("articles"), F.lit("all"), F.lit("source"), "source", F.lit("decision"), "editorial_decision", F.lit("format"), "review_format", F.lit("response"), F.coalesce(F.col("has_author_response"), F.lit(False)).cast("string"))).alias("field", "value"))
    c = concerns.select("split", F.explode(F.create_map(F.lit("concerns"), F.lit("all"), F.lit("severity"), "severity", F.lit("category"), "category", F.lit("stance"), "author_stance")).alias("field", "value"))
    both = a.unionByName(c).withColumn("split", F.coalesce("split", F.lit("unassigned")))
    return both.groupingSets([["split", "field", "value"], ["field", "value"]], "split", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def count_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, median, sample deviation (0 for one row), least, most and total of a count."""
    v = F.col(value)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"),
    )


def histogram(df: DataFrame, by: list[str], score: str, bins: int = 30) -> DataFrame:
    """Counts per bin of [0, 1]; scores beyond either end count in the end bins."""
    b = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def upper_median(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Element at position n // 2 of the sorted scores, found from counts per value instead of a gathered list."""
    n = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    n = n.withColumn("upto", F.sum("n").over(w.orderBy(score))).withColumn("all", F.sum("n").over(w))
    return n.where("upto > floor(all / 2) and upto - n <= floor(all / 2)").select(*by, F.col(score).alias("upper_median"))


def dominant_label(df: DataFrame, by: str, label: str) -> DataFrame:
    """Most frequent label; ties go to the first in the alphabet."""
    n = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), label)).alias("dominant"))


def cross_source_duplicates(articles: DataFrame, doi: Column) -> DataFrame:
    """DOIs that several sources list: (doi, n_rows, sources)."""
    a = articles.select(doi.alias("doi"), "source").where("doi is not null")
    return a.groupBy("doi").agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1).select("doi", "n_rows", F.array_join("s", "+").alias("sources"))


def article_chars(title: Column, abstract: Column, sections: Column) -> Column:
    """Characters of title, abstract and all sections."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    values = F.coalesce(F.map_values(sections), F.array().cast("array<string>"))
    return n(title) + n(abstract) + F.aggregate(values, F.lit(0), lambda a, x: a + n(x))


def input_cost(articles: DataFrame, chars: Column, cap: int, price_in: float, price_out: float, by: str, answer: int = 1500) -> DataFrame:
    """Estimated tokens and cost: a quarter of the characters, at most ``cap`` an article, and ``answer`` tokens of output each; prices are per million."""
    tokens = F.floor(F.sum(F.least(chars, F.lit(cap))) / 4)
    out = articles.groupBy(by).agg(F.count(F.lit(1)).alias("n"), tokens.alias("tokens")).withColumn("output_tokens", F.col("n") * answer)
    return out.withColumn("cost", (F.col("tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)


def transitions(df: DataFrame, old: str, new: Column) -> DataFrame:
    """(old, new, n): how often a re-inference changes a value to which."""
    return df.groupBy(F.coalesce(F.col(old), F.lit("unknown")).alias("old"), F.coalesce(new, F.lit("unknown")).alias("new")).agg(F.count(F.lit(1)).alias("n"))


def manifest_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counters of a subset's manifest, one pass over the rows for all fields."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def descriptive_rate(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """(by..., n, hits, rate): a share without an interval; NULL is no hit."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    return out.withColumn("rate", F.try_divide(F.col("hits").cast("double"), F.col("n")))


def price_of(model: str, prices: dict[str, float], default: float) -> float:
    """Price of a model: exact name, else the longest name it starts with, else the default."""
    if model in prices:
        return prices[model]
    starts = [k for k in prices if model.startswith(k)]
    return prices[max(starts, key=len)] if starts else default
