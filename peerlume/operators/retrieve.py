"""BM25 retrieval of concerns as plain plans: postings, scores, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlume.functions.text import retrieval_tokens, squeezed
from peerlume.session import materialised

# Defaults of the baseline.
K1, B, TOP_DOCS, TOP_CONCERNS = 1.5, 0.75, 8, 12

BLOCK_TERMS = 1_000_000  # (query, term) rows of a broadcast block, about 30 MB
PAIRS_A_TASK = 1_500_000  # sums of (query, document) that a task holds at once


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build_index(docs: DataFrame, doc: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """Weighted postings (term, doc, weight); articles without a token are left out.

    Everything that does not depend on a query - idf, term frequency, length norm - is one number
    per posting, so a search is a join and a sum.
    """
    tok = docs.select(F.col(doc).alias("doc"), F.explode(retrieval_tokens(F.col(text))).alias("term"))
    tf = materialised(tok.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    length = tf.groupBy("doc").agg(F.sum("tf").alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    joined = tf.join(length, "doc").join(terms, "term").join(F.broadcast(stats), F.lit(True))  # stats is one row
    return materialised(joined.select("term", "doc", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight")), "index")


def search(index: DataFrame, queries: DataFrame, query: str, text: str, block: int = BLOCK_TERMS) -> DataFrame:
    """(query, doc, score) of every document that shares a term with a query; query terms count once.

    The postings are shuffled once, by document; the queries' terms come to them in broadcast blocks
    of about ``block`` rows. So a document's scores are summed where its postings lie, and a top-k
    over them leaves each task with k rows a query: hot terms and the pairs themselves are never
    shuffled.
    """
    terms = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(retrieval_tokens(F.col(text)))).alias("term"))
    terms = materialised(terms, "query-terms")
    blocks = max(1, -(-terms.count() // block))
    # so many tasks that the pairs of one, which a whole text as a query may well have all, fit in memory
    pairs = index.select("doc").distinct().count() * terms.select("query").distinct().count()
    by_doc = index.repartition(max(default_partitions(index), -(-pairs // (blocks * PAIRS_A_TASK))), "doc")
    of = lambda b: terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
    parts = [by_doc.join(F.broadcast(of(b)), "term").groupBy("query", "doc").agg(F.sum("weight").alias("score")) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def top_docs(hits: DataFrame, k: int = TOP_DOCS, accept: Column | None = None) -> DataFrame:
    """(query, doc, score, rank) of the best k; equal scores by document number.

    Without ``accept`` the query's own article takes a rank and is dropped afterwards; with it only
    accepted documents are ranked at all.
    """
    hits = hits if accept is None else hits.where(accept)
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    ranked = hits.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked if accept is not None else ranked.where("doc <> query")


def vote(ranked: DataFrame, concerns: DataFrame, doc: str, text: str, n: int = TOP_CONCERNS) -> DataFrame:
    """(query, concern, weight, place): concerns of the retrieved documents by the sum of score / rank.

    Votes are shuffled by numbers that order the different texts; only the best n of a query get their text back.
    """
    c = concerns.select(F.col(doc).alias("doc"), squeezed(F.col(text)).alias("concern")).where("concern <> ''")
    texts = materialised(c.select("concern").distinct().orderBy("concern").withColumn("text_no", F.monotonically_increasing_id()), "concern-texts")
    s = ranked.select("query", "doc", "score", "rank").join(c.join(texts, "concern").select("doc", "text_no"), "doc")
    s = s.select("query", "text_no", (F.col("score") / F.col("rank")).alias("part")).repartition("query").groupBy("query", "text_no").agg(F.sum("part").alias("weight"))
    w = Window.partitionBy("query").orderBy(F.round("weight", 9).desc(), "text_no")
    best = s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return best.join(texts, "text_no").select("query", "concern", "weight", "place")


def first_relative_rank(hits: DataFrame, families: DataFrame) -> DataFrame:
    """(query, rank): rank of the first retrieved article of the query's own family, other than itself."""
    f = families.where("family is not null")
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
    ranked = hits.where("doc <> query and score > 0").withColumn("rank", F.row_number().over(w))
    same = ranked.join(f.select(F.col("entry_no").alias("query"), F.col("family").alias("fq")), "query").join(f.select(F.col("entry_no").alias("doc"), "family"), "doc")
    return same.where("family = fq").groupBy("query").agg(F.min("rank").alias("rank"))
