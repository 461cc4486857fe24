"""Queries on retrieval, rankings and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions.text import RETRIEVAL_STOPWORDS, article_text, f1000_family, ratio
from peerlume.operators import metrics, retrieve, score, stats
from peerlume.plans import bind
from peerlume.plans.bind import SQL_ARTICLES, SQL_MATCHING, sql_ratio, sql_scores
from peerlume.plans.corpus import _RATERS, _rater_pairs
from peerlume.plans.evaluation import matching
from peerlume.plans.registry import Registry

R = Registry()
QUERY_EVERY = 20  # queries of bm25_topk are the articles whose number is divisible by 20, against all


def _corpus(spark: SparkSession, sf_dir: str, every: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles with concerns, the articles that are queries (all, or those of every so many numbers) and the concerns."""
    a = bind.articles(spark, sf_dir)
    text = article_text(F.col("title"), F.col("abstract"), F.map_values("paper_text_sections"))
    docs = a.select("entry_no", text.alias("text"), f1000_family(F.col("source"), F.col("doi")).alias("family"))
    ref = bind.reference(spark, sf_dir).where(F.trim("text") != "")
    return docs.join(ref.select("entry_no"), "entry_no", "left_semi"), docs if every == 1 else docs.where(F.col("entry_no") % every == 0), ref


def _best(spark: SparkSession, sf_dir: str, accept: str = score.ANY, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """Hits of which at least the best of each query are there, and the concerns."""
    docs, queries, ref = _corpus(spark, sf_dir, every)
    return score.best(score.corpus(docs, "entry_no", "text", "family"), queries, "entry_no", "text", "family", retrieve.TOP_DOCS, accept), ref


_STOP = ", ".join(f"'{w}'" for w in RETRIEVAL_STOPWORDS)
_BM25 = f"""{SQL_ARTICLES}, ref as (select * from concerns where not coalesce(requires_figure_reading, false) and trim(concern_text) <> ''),
txt as (select entry_no, case when source = 'f1000' then nullif(regexp_extract(lower(trim(doi)), '^(10\\.12688/f1000research\\.[^.]+)\\.[0-9]+$', 1), '') end as family,
  array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(abstract, '')], coalesce(map_values(paper_text_sections), [])), lambda x: length(trim(x)) > 0), chr(10)) as text from art),
tok as materialized (select entry_no, family, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_STOP})) as t from txt),
tf as materialized (select entry_no as doc, term, count(*) as tf from (select entry_no, unnest(t) as term from tok where entry_no in (select entry_no from ref)) group by 1, 2),
len as (select doc, sum(tf)::bigint as len from tf group by 1), st as (select count(*) as n_docs, avg(len) as avg_len from len),
idf as (select term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) as idf from (select term, count(*) as df from tf group by 1) cross join st),
hits as materialized (select q.entry_no as query, tf.doc, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score
  from (select entry_no, unnest(list_distinct(t)) as term from tok where entry_no % {QUERY_EVERY} = 0) q join idf using (term) join tf using (term) join len on len.doc = tf.doc cross join st group by 1, 2),
ranked as materialized (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from hits),
best as (select * from ranked where rank <= {retrieve.TOP_DOCS} and doc <> query)"""
_BM25_ALL = _BM25.replace(f" where entry_no % {QUERY_EVERY} = 0", "")  # every article is a query


@R.add(f"with {_BM25} select query, doc, rank, round(score, 6) as score from best")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best articles for every twentieth article; the article itself takes a rank and is dropped."""
    hits, _ = _best(spark, sf_dir, every=QUERY_EVERY)
    return retrieve.top_docs(hits).select("query", "doc", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@R.add(
    f"""with {_BM25_ALL}, v as (select query, trim(regexp_replace(concern_text, '\\s+', ' ', 'g')) as concern, sum(score / rank) as weight from best join ref on ref.entry_no = best.doc group by 1, 2)
select query, concern, round(weight, 6) as weight, place from (select *, row_number() over (partition by query order by round(weight, 9) desc, concern) as place from v) where place <= {retrieve.TOP_CONCERNS}"""
)
def bm25_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns voted for by the articles retrieved for each article."""
    hits, ref = _best(spark, sf_dir)
    v = retrieve.vote(retrieve.top_docs(hits), ref, "entry_no", "text")
    return v.select("query", "concern", F.round("weight", 6).alias("weight"), F.col("place").cast("bigint").alias("place"))


@R.add(
    f"""with {_BM25_ALL}, f as (select h.*, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from hits h join tok a on a.entry_no = h.query join tok b on b.entry_no = h.doc
  where h.doc <> h.query and (a.family is null or b.family is null or a.family <> b.family))
select query, doc, rank, round(score, 6) as score from f where rank <= {retrieve.TOP_DOCS}"""
)
def bm25_family_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best articles when versions of the query's own manuscript are passed over before ranking."""
    hits, _ = _best(spark, sf_dir, score.OTHERS)
    fam = bind.articles(spark, sf_dir).select("entry_no", f1000_family(F.col("source"), F.col("doi")).alias("family"))
    h = hits.join(fam.select(F.col("entry_no").alias("query"), F.col("family").alias("fq")), "query").join(fam.select(F.col("entry_no").alias("doc"), F.col("family").alias("fd")), "doc")
    other = F.col("fq").isNull() | F.col("fd").isNull() | (F.col("fq") != F.col("fd"))
    top = retrieve.top_docs(h, accept=(F.col("doc") != F.col("query")) & other)
    return top.select("query", "doc", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@R.add(
    f"""with {_BM25_ALL}, o as (select h.*, row_number() over (partition by query order by round(score, 9) desc, doc) as r from hits h where doc <> query)
select o.query, min(r) as rank from o join tok a on a.entry_no = o.query join tok b on b.entry_no = o.doc where a.family = b.family group by 1"""
)
def first_family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first retrieved version of the query's own manuscript."""
    docs, queries, _ = _corpus(spark, sf_dir)
    return score.first_ranks(score.corpus(docs, "entry_no", "text", "family"), queries, "entry_no", "text", "family")


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.micro(m.counts.join(m.articles.select("entry_no", "source"), "entry_no"), "source", "model")


_BY_SOURCE = f"bs as materialized (select *, {sql_scores()} from (select source, model, sum(n_ref)::bigint as n_ref, sum(n_tool)::bigint as n_tool, sum(n_matched)::bigint as n_matched from counts join art using (entry_no) group by 1, 2))"


def _sql(body: str, extra: str = _BY_SOURCE) -> str:
    return f"with recursive {SQL_MATCHING}, {extra} {body}"


@R.add(_sql("select model as tool, source as version, f1, recall, row_number() over (order by f1 desc, recall desc, model, source) as rank from bs"))
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (model and source) ranked by F1, then recall."""
    r = _by_source(spark, sf_dir).select(F.col("model").alias("tool"), F.col("source").alias("version"), "f1", "recall", F.lit("2024-01-01").alias("run_date"), "n_ref", "n_tool")
    return stats.leaderboard(stats.homogeneous(r.withColumn("algorithm", F.lit("greedy")), ["algorithm"]), ["tool", "version"]).select("tool", "version", "f1", "recall", F.col("rank").cast("bigint").alias("rank"))


@R.add(_sql("select source, model, f1, f1 = max(f1) over (partition by source) as is_best from bs"))
def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model is best on each source."""
    from pyspark.sql import Window

    return _by_source(spark, sf_dir).select("source", "model", "f1", (F.col("f1") == F.max("f1").over(Window.partitionBy("source"))).alias("is_best"))


@R.add(_sql("select source, model, rank() over (partition by source order by n_matched desc) + (count(*) over (partition by source, n_matched) - 1) / 2 as rank from bs"))
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank of models by matched concerns within a source."""
    return stats.with_average_rank(_by_source(spark, sf_dir), ["source"], "n_matched").select("source", "model", "rank")


_TAU = "w as (select a.source, a.f1 as x, b.f1 as y from bs a join bs b using (source) where a.model = 'drop4' and b.model = 'drop2'), pr as (select sign(a.x - b.x) * sign(a.y - b.y) as s, a.x = b.x as tx, a.y = b.y as ty from w a join w b on a.source < b.source)"


@R.add(_sql("select count(*) as n_pairs, sum(s) / count(*) as tau_a, sum(s) / sqrt(((count(*) - count(*) filter (tx))::double * (count(*) - count(*) filter (ty)))) as tau_b from pr", _BY_SOURCE + ", " + _TAU))
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two models on the order of the sources."""
    b = _by_source(spark, sf_dir)
    w = b.where("model = 'drop4'").select("source", F.col("f1").alias("x")).join(b.where("model = 'drop2'").select("source", F.col("f1").alias("y")), "source")
    return stats.kendall(w, "source", "x", "y")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = matching(spark, sf_dir).counts
    a, b = (c.where(F.col("model") == m).select("entry_no", F.col("n_matched").alias(n)) for m, n in (("drop4", "x"), ("drop3", "y")))
    return a.join(b, "entry_no").select("entry_no", (F.col("x") - F.col("y")).alias("diff"))


@R.add(
    _sql(
        """select n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) as z from (
  select sum(n)::bigint as n, sum(rank * up) as w_plus, sum(rank * (n - up)) as w_minus, sum(n * n * n - n) as ties from (
    select n, up, sum(n) over (order by size) - (n - 1) / 2 as rank from (select abs(d) as size, count(*) as n, count(*) filter (d > 0) as up from (
      select a.n_matched - b.n_matched as d from counts a join counts b using (entry_no) where a.model = 'drop4' and b.model = 'drop3') where d <> 0 group by 1)))"""
    )
)
def wilcoxon_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank statistic of two models' matches per article."""
    d = _diffs(spark, sf_dir).withColumn("all", F.lit(1))
    return stats.wilcoxon(d, ["all"], "diff").drop("all").withColumn("z", F.round("z", 9))


@R.add(
    _sql(
        """, x as (select row_number() over (order by a.source) - 1 as i, (a.n_matched - b.n_matched)::double as d from bs a join bs b using (source) where a.model = 'drop4' and b.model = 'drop3' and a.n_matched <> b.n_matched),
k as (select count(*)::int as n, abs(sum(d)) as obs from x),
s as (select m, abs(sum(case when (m >> i) & 1 = 1 then -d else d end)) as v from x, (select unnest(range(0, (1 << (select n from k))::bigint)) as m) group by m)
select (select n from k) as n, count(*) filter (v >= (select obs from k) - 1e-12) / count(*) as p from s""".lstrip(", "),
        _BY_SOURCE + ", x0 as (select 1)",
    ).replace("x0 as (select 1) x as", "x as")
)
def sign_flip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sign-flip test of two models over the sources."""
    b = _by_source(spark, sf_dir)
    w = b.where("model = 'drop4'").select("source", F.col("n_matched").alias("x")).join(b.where("model = 'drop3'").select("source", F.col("n_matched").alias("y")), "source")
    return stats.sign_flip_exact(w.select(F.lit(1).alias("all"), (F.col("x") - F.col("y")).alias("diff")), ["all"], "diff").drop("all")


@R.add(
    _sql(
        """, x as (select row_number() over (order by a.source) - 1 as i, a.n_matched as m1, a.n_tool as t1, b.n_matched as m2, b.n_tool as t2, a.n_ref as r from bs a join bs b using (source) where a.model = 'drop4' and b.model = 'drop3'),
s as (select m, abs(2 * sum(case when b then m2 else m1 end) / (sum(r) + sum(case when b then t2 else t1 end)) - 2 * sum(case when b then m1 else m2 end) / (sum(r) + sum(case when b then t1 else t2 end))) as v
  from (select *, (m >> i) & 1 = 1 as b from x, (select unnest(range(0, (1 << (select count(*) from x)::int)::bigint)) as m)) group by m)
select (select count(*)::int from x) as n, count(*) filter (v >= (select v from s where m = 0) - 1e-12) / count(*) as p from s""".lstrip(", "),
        _BY_SOURCE + ", x0 as (select 1)",
    ).replace("x0 as (select 1) x as", "x as")
)
def micro_f1_swap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact randomisation test of two models' micro-F1 over the sources."""
    b = _by_source(spark, sf_dir)
    a = b.where("model = 'drop4'").select("source", F.col("n_matched").alias("m1"), F.col("n_tool").alias("t1"), F.col("n_ref").alias("r"))
    c = b.where("model = 'drop3'").select("source", F.col("n_matched").alias("m2"), F.col("n_tool").alias("t2"))
    return stats.micro_f1_swap_exact(a.join(c, "source").withColumn("all", F.lit(1)), ["all"]).drop("all")


@R.add(
    _sql(
        """select 'drop4-drop3' as comparison, n, case when n = 0 then 1.0 else (1 + (select count(*) from reached where v >= observed - 1e-12)) / 10001.0::double end as p from (
  select coalesce(sum(pairs) filter (size <> 0), 0)::bigint as n, abs(sum(size * signs)) as observed from sizes)""",
        """sizes as materialized (select abs(d) as size, count(*) as pairs, sum(sign(d)) as signs from (
  select a.n_matched - b.n_matched as d from counts a join counts b using (entry_no) where a.model = 'drop4' and b.model = 'drop3') group by 1),
words as (select size, w, least(32, pairs - 32 * w) as bits from (select *, unnest(range(0, (pairs - 1) // 32 + 1)) as w from sizes where size <> 0)),
reached as (select draw, abs(sum(size * (2 * bit_count(('0x' || substring(md5('42:' || draw || ':' || size || ':' || w), 1, 8))::bigint & ((1::bigint << bits::bigint) - 1)) - bits))) as v
  from words, (select unnest(range(0, 10000)) as draw) group by 1)""",
    )
)
def sign_flip_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled sign-flip test of two models over all articles."""
    d = _diffs(spark, sf_dir).select(F.lit("drop4-drop3").alias("comparison"), "diff")
    return stats.sign_flip_sampled(d, ["comparison"], "diff")


REPLICATES = 100
_POISSON = "case " + " ".join(f"when u < {b!r} then {k}" for b, k in [(0.36787944117144233, 0), (0.7357588823428847, 1), (0.9196986029286058, 2), (0.9810118431238462, 3), (0.9963401531726563, 4), (0.9994058151824183, 5), (0.999916758850712, 6)]) + " else 7 end"


def _u(key: str) -> str:
    return f"('0x' || substring(md5('42:' || rep || ':' || {key}), 1, 8))::bigint / 4294967296.0::double"


@R.add(
    _sql(
        f"""select model, s1[3] as recall_low, s1[97] as recall_high, s2[3] as precision_low, s2[97] as precision_high from (
  select model, list_sort(list({sql_ratio('m', 'r')})) as s1, list_sort(list({sql_ratio('m', 't')})) as s2 from (
    select model, rep, sum(w * n_ref) as r, sum(w * n_tool) as t, sum(w * n_matched) as m from (select *, {_POISSON} as w from (select c.*, rep, {_u('entry_no')} as u from counts c, (select unnest(range(0, {REPLICATES})) as rep))) group by 1, 2) group by 1)"""
    )
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of recall and precision per model over a hundred resamples of the articles."""
    return stats.bootstrap_ci(matching(spark, sf_dir).counts, ["model"], "entry_no", REPLICATES)


@R.add(
    f"""with {_RATERS}, q as (select source, article_doi, count(*) as n, count(*) filter (a = b) as same from (select p.*, coalesce(c.article_doi, '~') as article_doi from p join concerns c using (concern_no)) group by 1, 2),
s as (select source, rep, sum(w * same)::double / nullif(sum(w * n), 0) as agreement from (select *, {_POISSON} as w from (select q.*, rep, {_u('article_doi')} as u from q, (select unnest(range(0, {REPLICATES})) as rep))) group by 1, 2)
select source, round(quantile_cont(agreement, 0.025), 9) as low, round(quantile_cont(agreement, 0.975), 9) as high from s group by 1"""
)
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of two raters' agreement per source, resampling whole articles."""
    from peerlume.session import table

    p = _rater_pairs(spark, sf_dir).join(table(spark, sf_dir, "concerns").select("concern_no", F.coalesce("article_doi", F.lit("~")).alias("article_doi")), "concern_no")
    out = stats.cluster_bootstrap(p, ["source"], "article_doi", REPLICATES)
    return out.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@R.add(_sql(f"select source, {', '.join(f'{sql_ratio(f'max(n_tool) filter (model = {chr(39)}{m}{chr(39)})', 'max(n_ref)')} as volume_{m}' for m in bind.MODELS)} from bs group by 1"))
def volume_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted per reference concern, per source and model."""
    b = _by_source(spark, sf_dir)
    of = lambda m: ratio(F.max(F.when(F.col("model") == m, F.col("n_tool"))), F.max("n_ref")).alias(f"volume_{m}")
    return b.groupBy("source").agg(*[of(m) for m in bind.MODELS])
