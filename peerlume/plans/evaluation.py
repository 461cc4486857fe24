"""Queries on matching predicted with reference concerns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions.text import cohort, f1000_family, false_negative_kind, false_positive_kind, ratio
from peerlume.operators import match, metrics
from peerlume.plans import bind
from peerlume.plans.bind import SQL_MATCHING, sql_greedy, sql_ratio, sql_scores
from peerlume.plans.registry import Registry
from peerlume.session import materialised, table

R = Registry()
T = match.effective_threshold(match.EMBEDDING_THRESHOLD, "jaccard")
THRESHOLDS = [0.05, 0.1, 0.195, 0.3, 0.5, 0.7]


@dataclass
class Matching:
    articles: DataFrame
    ref: DataFrame
    tool: DataFrame
    edges: DataFrame
    matched: DataFrame
    counts: DataFrame


def matching(spark: SparkSession, sf_dir: str) -> Matching:
    """Edges are scored once and written, since matching, credits and neighbours all read them."""
    a, ref, tool = bind.articles(spark, sf_dir), bind.reference(spark, sf_dir), bind.predictions(spark, sf_dir)
    edges = materialised(match.jaccard_edges(tool, ref), "edges")
    matched = match.greedy_matches(edges, T)
    return Matching(a, ref, tool, edges, matched, metrics.article_counts(a, bind.models(spark), tool, ref, matched))


def _sql(body: str, extra: str = "") -> str:
    return f"with recursive {SQL_MATCHING}{', ' + extra if extra else ''} {body}"


_SUMS = "count(*) as n_articles, " + ", ".join(
    f"sum({c})::bigint as {c}" for c in ("n_ref", "n_tool", "n_matched", "n_ref_major", "n_ref_minor", "n_matched_major", "n_matched_minor")
)


@R.add(_sql(f"select *, {sql_scores()} from (select source, model, {_SUMS} from counts join art using (entry_no) group by 1, 2)"))
def micro_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.micro(m.counts.join(m.articles.select("entry_no", "source"), "entry_no"), "source", "model")


@R.add(_sql(f"select model, entry_no, n_ref, n_tool, n_matched, {sql_scores()} from counts"))
def article_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = matching(spark, sf_dir).counts
    return c.select("model", "entry_no", "n_ref", "n_tool", "n_matched", *metrics.scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))


_SEVERITY = ", ".join(f"sum({c})::bigint as {c}" for c in ("n_ref_major", "n_matched_major", "n_ref_minor", "n_matched_minor"))


@R.add(_sql(f"select *, {sql_ratio('n_matched_major', 'n_ref_major')} as recall_major, {sql_ratio('n_matched_minor', 'n_ref_minor')} as recall_minor from (select model, {_SEVERITY} from counts group by 1)"))
def severity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.severity_recall(matching(spark, sf_dir).counts, "model")


_CATEGORIES = """near as (
  select model, entry_no, tool_no, ref_no from (select *, row_number() over (partition by model, entry_no, tool_no order by score desc, ref_no) as k from edges) where k = 1
), free as (select * from near n where not exists (select 1 from matched m where m.model = n.model and m.entry_no = n.entry_no and m.tool_no = n.tool_no)),
kind as (select ref_no, coalesce(category, 'other') as category from ref),
cats as (
  select m.model, c.category, c.n_ref, coalesce(h.n, 0) + coalesce(f.n, 0) as n_tool, coalesce(h.n, 0) as n_matched
  from (select category, count(*) as n_ref from kind group by 1) c cross join models m
  left join (select model, category, count(*) as n from matched join kind using (ref_no) group by 1, 2) h on h.model = m.model and h.category = c.category
  left join (select model, category, count(*) as n from free join kind using (ref_no) group by 1, 2) f on f.model = m.model and f.category = c.category
)"""


@R.add(_sql(f"select *, {sql_scores()} from cats", _CATEGORIES))
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.category_counts(m.ref, m.tool, m.edges, m.matched)


@R.add(_sql(f"select model, count(*) as n_categories, round(avg(f1), 9) as macro_f1 from (select model, {sql_scores()} from cats) group by 1", _CATEGORIES))
def category_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.macro_f1(metrics.category_counts(m.ref, m.tool, m.edges, m.matched)).withColumn("macro_f1", F.round("macro_f1", 9))


@R.add(
    _sql(
        """select model, round(avg(case when n_ref = 0 then 0 else coalesce(rc, 0) / n_ref end), 9) as soft_recall,
  round(avg(case when n_tool = 0 then 0 else coalesce(tc, 0) / n_tool end), 9) as soft_precision, count(*) as n_articles
  from counts c
  left join (select model, entry_no, sum(s) as rc from (select model, entry_no, ref_no, max(score) as s from edges group by all) group by all) using (model, entry_no)
  left join (select model, entry_no, sum(s) as tc from (select model, entry_no, tool_no, max(score) as s from edges group by all) group by all) using (model, entry_no)
  group by model"""
    )
)
def soft_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    out = metrics.soft_metrics(m.edges, m.counts)
    return out.select("model", F.round("soft_recall", 9).alias("soft_recall"), F.round("soft_precision", 9).alias("soft_precision"), "n_articles")


@R.add()
def hungarian_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and total score of the optimal matching per model and article, beside the greedy one."""
    m = matching(spark, sf_dir)
    best = match.hungarian_matches(m.edges, T).groupBy("model", "entry_no").agg(F.count(F.lit(1)).alias("n_optimal"), F.round(F.sum("score"), 9).alias("total_optimal"))
    greedy = m.matched.groupBy("model", "entry_no").agg(F.count(F.lit(1)).alias("n_greedy"), F.round(F.sum("score"), 9).alias("total_greedy"))
    return best.join(greedy, ["model", "entry_no"])


@R.add(
    """with recursive v as materialized (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) as k from embeddings),
g as (
  select label, k, [vec_id] as kept, true as ok, vec_id from v where k = 1
  union all
  select v.label, v.k, case when z.ok then list_append(g.kept, v.vec_id) else g.kept end, z.ok, v.vec_id
  from g join v on v.label = g.label and v.k = g.k + 1,
  lateral (select not exists (select 1 from v w where w.label = v.label and list_contains(g.kept, w.vec_id) and list_dot_product(w.embedding::double[], v.embedding::double[]) >= 0.25) as ok) z
) select label, vec_id from g where ok"""
)
def dedup_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept when later near-duplicates inside a label are dropped (threshold 0.25 on these random vectors)."""
    return match.deduplicated(table(spark, sf_dir, "embeddings"), "label", "vec_id", threshold=0.25)


@R.add(
    """select label, count(*) as n_pairs, count(*) filter (s >= 0.2) as n_edges from (
  select a.label, list_dot_product(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b using (label) where a.vec_id % 2 = 0 and b.vec_id % 2 = 1
) group by 1"""
)
def embedding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of even and odd vectors of a label, and those at a cosine of 0.2 or more."""
    e = table(spark, sf_dir, "embeddings")
    tool = e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "tool_no")
    ref = e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "ref_no")
    return match.cosine_edges(tool, ref, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("score") >= 0.2).alias("n_edges"))


_SWEEP = f"""marks as (select unnest({THRESHOLDS}::double[]) as threshold), many as materialized (select e.*, threshold from edges e join marks on threshold <= score),
{sql_greedy("many", THRESHOLDS[0], "swept", "threshold, model, entry_no")},
sweep as (
  select model, threshold, n_ref, n_tool, coalesce(n, 0) as n_matched from (select model, sum(n_ref)::bigint as n_ref, sum(n_tool)::bigint as n_tool from counts group by 1) cross join marks
  left join (select model, threshold, count(*) as n from swept group by 1, 2) using (model, threshold)
)"""


@R.add(_sql(f"select *, {sql_scores()} from sweep", _SWEEP))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.threshold_sweep(m.edges, m.counts, THRESHOLDS, match.greedy_matches)


@R.add(
    _sql(
        f"""select model, round(sum(coalesce((recall - r0) * (precision + p0) / 2, 0)), 9) as auc_pr, max(f1) as best_f1, arg_max(threshold, f1 - threshold * 1e-9) as best_threshold from (
  select *, lag(recall) over w as r0, lag(precision) over w as p0 from (select *, {sql_scores()} from sweep) window w as (partition by model order by recall, threshold)
) group by 1""",
        _SWEEP,
    )
)
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching(spark, sf_dir)
    return metrics.auc_pr(metrics.threshold_sweep(m.edges, m.counts, THRESHOLDS, match.greedy_matches)).withColumn("auc_pr", F.round("auc_pr", 9))


_ERRORS = """fp as (select t.model, t.entry_no, t.tool_no, t.text from tool t where not exists (select 1 from matched m where m.model = t.model and m.entry_no = t.entry_no and m.tool_no = t.tool_no)),
fn as (select m.model, r.entry_no, r.ref_no, r.text, r.category from ref r cross join models m where not exists (select 1 from matched x where x.model = m.model and x.ref_no = r.ref_no)),
nt as (select model, entry_no, tool_no, ref_no as nearest, score from (select *, row_number() over (partition by model, entry_no, tool_no order by score desc, ref_no) as k from edges) where k = 1),
nr as (select model, entry_no, ref_no, tool_no as nearest, score from (select *, row_number() over (partition by model, entry_no, ref_no order by score desc, tool_no) as k from edges) where k = 1)"""


@R.add(
    _sql(
        """select 'fp' as kind, model, fp.entry_no, fp.tool_no as concern, nearest, score as nearest_score from fp left join nt using (model, entry_no, tool_no)
  union all select 'fn', model, fn.entry_no, fn.ref_no, nearest, score from fn left join nr using (model, entry_no, ref_no)""",
        _ERRORS,
    )
)
def fp_fn_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched predictions and missed references, each with its most similar counterpart."""
    fp, fn = _errors(spark, sf_dir)
    return fp.select(F.lit("fp").alias("kind"), "model", "entry_no", F.col("tool_no").alias("concern"), "nearest", "nearest_score").unionByName(
        fn.select(F.lit("fn").alias("kind"), "model", "entry_no", F.col("ref_no").alias("concern"), "nearest", "nearest_score")
    )


def _errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = matching(spark, sf_dir)
    fp = m.tool.join(m.matched, ["model", "entry_no", "tool_no"], "left_anti").join(match.nearest(m.edges, "tool_no"), ["model", "entry_no", "tool_no"], "left")
    every = m.ref.select("*", F.explode(F.array(*[F.lit(x) for x in bind.MODELS])).alias("model"))
    fn = every.join(m.matched.select("model", "ref_no"), ["model", "ref_no"], "left_anti").join(match.nearest(m.edges, "ref_no"), ["model", "entry_no", "ref_no"], "left")
    return fp, fn


def _sql_any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{p}')" for p in phrases) + ")"


def _sql_fp(c: str) -> str:
    from peerlume.functions.text import FALSE_POSITIVE_DEFAULT, FALSE_POSITIVE_PHRASES

    return "case " + " ".join(f"when {_sql_any(c, p)} then '{k}'" for k, p in FALSE_POSITIVE_PHRASES.items()) + f" else '{FALSE_POSITIVE_DEFAULT}' end"


def _sql_fn(c: str, category: str) -> str:
    from peerlume.functions.text import MISSED_BY_CATEGORY

    return f"case when length({c}) < 80 then 'vague_gt_concern' " + " ".join(f"when {category} = '{k}' then '{v}'" for k, v in MISSED_BY_CATEGORY.items()) + " else 'other_missed' end"


@R.add(
    _sql(
        f"""select kind, model, label, count(*) as n, count(*) filter (coalesce(score, 0) >= 0.1) as near_misses from (
  select 'fp' as kind, model, {_sql_fp('text')} as label, score from fp left join nt using (model, entry_no, tool_no)
  union all select 'fn', model, {_sql_fn('text', 'category')}, score from fn left join nr using (model, entry_no, ref_no)) group by 1, 2, 3""",
        _ERRORS,
    )
)
def fp_fn_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of errors per model, and how many of them nearly matched."""
    fp, fn = _errors(spark, sf_dir)
    both = fp.select(F.lit("fp").alias("kind"), "model", false_positive_kind(F.col("text")).alias("label"), "nearest_score").unionByName(
        fn.select(F.lit("fn").alias("kind"), "model", false_negative_kind(F.col("text"), F.col("category")).alias("label"), "nearest_score")
    )
    near = F.count_if(F.coalesce("nearest_score", F.lit(0.0)) >= 0.1)
    return both.groupBy("kind", "model", "label").agg(F.count(F.lit(1)).alias("n"), near.alias("near_misses"))


_YEAR = "try_cast(regexp_extract(published_date, '([0-9]{4})', 1) as int)"


@R.add(
    _sql(
        f"""select model, source, cohort, sum(n_matched)::bigint as tp, sum(n_tool - n_matched)::bigint as fp, sum(n_ref - n_matched)::bigint as fn from (
  select c.*, case when {_YEAR} is null then 'unknown' when {_YEAR} < 2022 then 'pre-2022' else '2022+' end as cohort, source from counts c join art using (entry_no)
) group by grouping sets ((model, cohort), (model, source, cohort))"""
    )
)
def cohort_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false positives and misses per model and cohort, for all sources (NULL) and each source."""
    m = matching(spark, sf_dir)
    year = F.try_to_number(F.regexp_extract("published_date", r"(\d{4})", 1), F.lit("9999")).cast("int")
    c = m.counts.join(m.articles.select("entry_no", "source", cohort(year, 2022).alias("cohort")), "entry_no")
    sums = [F.sum("n_matched").alias("tp"), F.sum(F.col("n_tool") - F.col("n_matched")).alias("fp"), F.sum(F.col("n_ref") - F.col("n_matched")).alias("fn")]
    return c.groupingSets([["model", "cohort"], ["model", "source", "cohort"]], "model", "source", "cohort").agg(*sums)


# two extractors: models drop4 and drop3 as predictions of the same articles
_PAIR = """a as (select * from tool where model = 'drop4'), b as (select * from tool where model = 'drop3'),
pe as materialized (
  select 'pair' as model, x.entry_no, x.tool_no, y.tool_no as ref_no, case when len(x.tok) = 0 or len(y.tok) = 0 then 0.0::double
    else len(list_intersect(x.tok, y.tok))::double / (len(x.tok) + len(y.tok) - len(list_intersect(x.tok, y.tok))) end as score
  from (select * from tt where model = 'drop4') x join (select * from tt where model = 'drop3') y using (entry_no)
), """ + sql_greedy("pe", T, "pm")  # fmt: skip


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    tool = bind.predictions(spark, sf_dir)
    a = tool.where("model = 'drop4'").withColumn("model", F.lit("pair"))
    b = tool.where("model = 'drop3'").drop("model").withColumnRenamed("tool_no", "ref_no")
    edges = materialised(match.jaccard_edges(a, b), "pair-edges")
    return a, b, edges, match.greedy_matches(edges, T)


_ENSEMBLE = _PAIR + f""", ens as (
  select x.entry_no, x.tool_no as concern, x.text, x.category, case when x.severity = 'major' or y.severity = 'major' then 'major' else x.severity end as severity,
    coalesce(x.category, 'other') = coalesce(y.category, 'other') as category_agreed, 'both' as agreement
  from pm join a x on x.entry_no = pm.entry_no and x.tool_no = pm.tool_no join b y on y.entry_no = pm.entry_no and y.tool_no = pm.ref_no
  union all
  select x.entry_no, x.tool_no, x.text, x.category, x.severity, null, case when exists (select 1 from b where b.entry_no = x.entry_no) then 'first_only_borderline' else 'first_without_second' end
  from a x where not exists (select 1 from pm where pm.entry_no = x.entry_no and pm.tool_no = x.tool_no)
    and (not exists (select 1 from b where b.entry_no = x.entry_no) or (select max(score) from pe where pe.entry_no = x.entry_no and pe.tool_no = x.tool_no) >= 0.15)
  union all
  select y.entry_no, y.tool_no, y.text, y.category, y.severity, null, 'second_only_borderline'
  from b y where not exists (select 1 from pm where pm.entry_no = y.entry_no and pm.ref_no = y.tool_no) and (select max(score) from pe where pe.entry_no = y.entry_no and pe.ref_no = y.tool_no) >= 0.15
)"""


def _ensemble(spark: SparkSession, sf_dir: str, borderline: float = 0.15) -> DataFrame:
    """Concerns both extractors found (the first one's text, major if either says so), and borderline ones of either.

    An unmatched concern may be more similar than the matching threshold, if its counterpart went
    to another one; it still counts as borderline. Articles without a second extraction keep the first.
    """
    a, b, edges, matched = _pair(spark, sf_dir)
    second = b.select("entry_no", "ref_no", F.col("category").alias("c2"), F.col("severity").alias("s2"))
    major = F.coalesce(F.col("severity") == "major", F.lit(False)) | F.coalesce(F.col("s2") == "major", F.lit(False))
    both = matched.join(a, ["model", "entry_no", "tool_no"]).join(second, ["entry_no", "ref_no"])
    agreed = F.coalesce("category", F.lit("other")) == F.coalesce("c2", F.lit("other"))
    columns = ["entry_no", "concern", "text", "category", "severity", "category_agreed", "agreement"]
    out = both.select("entry_no", F.col("tool_no").alias("concern"), "text", "category", F.when(major, "major").otherwise(F.col("severity")).alias("severity"), agreed.alias("category_agreed"), F.lit("both").alias("agreement"))
    none = F.lit(None).cast("boolean").alias("category_agreed")
    has_second = b.select("entry_no").distinct().withColumn("has", F.lit(True))
    rest = a.join(matched, ["model", "entry_no", "tool_no"], "left_anti").join(match.nearest(edges, "tool_no"), ["model", "entry_no", "tool_no"], "left").join(has_second, "entry_no", "left")
    rest = rest.where(F.col("has").isNull() | (F.col("nearest_score") >= borderline))
    label = F.when(F.col("has").isNull(), "first_without_second").otherwise("first_only_borderline")
    first = rest.select("entry_no", F.col("tool_no").alias("concern"), "text", "category", "severity", none, label.alias("agreement"))
    left = b.join(matched.select("entry_no", "ref_no"), ["entry_no", "ref_no"], "left_anti").join(match.nearest(edges, "ref_no").where(F.col("nearest_score") >= borderline), ["entry_no", "ref_no"])
    last = left.select("entry_no", F.col("ref_no").alias("concern"), "text", "category", "severity", none, F.lit("second_only_borderline").alias("agreement"))
    return out.unionByName(first).unionByName(last).select(*columns)


@R.add(_sql("select * from ens", _ENSEMBLE))
def ensemble_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble(spark, sf_dir)


@R.add(
    _sql(
        f"""select source, n, n_both, {sql_ratio('n_both', 'n')} as share_both from (
  select source, count(*) as n, count(*) filter (agreement = 'both') as n_both from ens join art using (entry_no) group by rollup (source))""",
        _ENSEMBLE,
    )
)
def ensemble_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ensemble concerns both extractors found, per source and in all (NULL)."""
    e = _ensemble(spark, sf_dir).join(bind.articles(spark, sf_dir).select("entry_no", "source"), "entry_no")
    out = e.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("agreement") == "both").alias("n_both"))
    return out.withColumn("share_both", ratio(F.col("n_both"), F.col("n")))


@R.add(
    _sql(
        f"""select *, {sql_ratio('n_matched', 'n_first')} as forward, {sql_ratio('n_matched', 'n_second')} as backward from (
  select (select count(*) from a where entry_no in (select entry_no from b)) as n_first, (select count(*) from b where entry_no in (select entry_no from a)) as n_second, (select count(*) from pm) as n_matched)""",
        _PAIR,
    )
)
def extractor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of either extractor's concerns that the other one has too, over articles both have seen."""
    a, b, _, matched = _pair(spark, sf_dir)
    first = a.join(b.select("entry_no").distinct(), "entry_no", "left_semi").agg(F.count(F.lit(1)).alias("n_first"))
    second = b.join(a.select("entry_no").distinct(), "entry_no", "left_semi").agg(F.count(F.lit(1)).alias("n_second"))
    one = first.join(second, F.lit(True)).join(matched.agg(F.count(F.lit(1)).alias("n_matched")), F.lit(True))  # single rows
    return one.select("*", ratio(F.col("n_matched"), F.col("n_first")).alias("forward"), ratio(F.col("n_matched"), F.col("n_second")).alias("backward"))


_CONFUSED = _PAIR + """, conf as (select x.category as first, y.category as second, count(*) as n from pm join a x on x.entry_no = pm.entry_no and x.tool_no = pm.tool_no
  join b y on y.entry_no = pm.entry_no and y.tool_no = pm.ref_no where x.category is not null and y.category is not null group by 1, 2)"""  # fmt: skip


def _pairs_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _, matched = _pair(spark, sf_dir)
    p = matched.join(a.select("entry_no", "tool_no", F.col("category").alias("first")), ["entry_no", "tool_no"]).join(b.select("entry_no", "ref_no", F.col("category").alias("second")), ["entry_no", "ref_no"])
    return p.where("first is not null and second is not null").select("first", "second")


@R.add(
    _sql(
        "select x.label as first, y.label as second, coalesce(n, 0) as n from (select first as label from conf union select second from conf) x cross join (select first as label from conf union select second from conf) y left join conf on conf.first = x.label and conf.second = y.label",
        _CONFUSED,
    )
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of matched concerns' categories, zeros included (the labels are a short fixed list)."""
    counts = _pairs_of_labels(spark, sf_dir).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    labels = sorted({x for r in counts.collect() for x in (r.first, r.second)})  # at most the square of the categories
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "first string, second string")
    return grid.join(counts, ["first", "second"], "left").na.fill(0, ["n"])


@R.add(
    _sql(
        f"select label, n_both, n_either, {sql_ratio('n_both', 'n_either')} as agreement from (select label, sum(n) filter (first = second)::bigint as n_both, sum(n)::bigint as n_either from (select first as label, * from conf union all select second, * from conf where first <> second) group by 1)".replace("sum(n) filter (first = second)::bigint", "coalesce(sum(n) filter (first = second), 0)::bigint"),
        _CONFUSED,
    )
)
def category_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: pairs in which both, and in which either extractor chose it."""
    p = _pairs_of_labels(spark, sf_dir).select(F.explode(F.array_distinct(F.array("first", "second"))).alias("label"), (F.col("first") == F.col("second")).alias("same"))
    out = p.groupBy("label").agg(F.count_if("same").alias("n_both"), F.count(F.lit(1)).alias("n_either"))
    return out.withColumn("agreement", ratio(F.col("n_both"), F.col("n_either")))


@R.add(
    """with fam as (
  select regexp_extract(lower(trim(doi)), '^(10\\.12688/f1000research\\.[^.]+)\\.[0-9]+$', 1) as family, split from articles
  where lower(trim(source)) = 'f1000' and split is not null
), f as (select family, list_sort(list_distinct(list(split))) as splits, count(*) as n from fam where family <> '' group by 1)
select array_to_string(splits, '+') as splits, count(*) as families, sum(n)::bigint as rows, count(*) filter (n > 1) as multiversion,
  len(splits) > 1 as crossing, len(splits) > 1 and list_contains(splits, 'test') as crosses_test from f group by splits"""
)
def family_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many manuscript families lie in which combination of splits."""
    a = table(spark, sf_dir, "articles").where("split is not null")
    fam = a.select(f1000_family(F.trim("source"), F.col("doi")).alias("family"), "split").where("family is not null")
    f = fam.groupBy("family").agg(F.array_sort(F.collect_set("split")).alias("s"), F.count(F.lit(1)).alias("n"))
    out = f.groupBy("s").agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("multiversion"))
    return out.select(F.array_join("s", "+").alias("splits"), "families", "rows", "multiversion", (F.size("s") > 1).alias("crossing"), ((F.size("s") > 1) & F.array_contains("s", "test")).alias("crosses_test"))
