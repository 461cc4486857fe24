"""Queries on splits, summaries, exports, validation and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions import text as T
from peerlume.functions.keys import canonical_doi
from peerlume.operators import export, profile, split, validate
from peerlume.plans import bind
from peerlume.plans.bind import SQL_ARTICLES, sql_category, sql_ratio
from peerlume.plans.registry import Registry
from peerlume.session import table

R = Registry()
STRATA = ["source", "editorial_decision", "review_format"]
_POS = "row_number() over (partition by {s} order by md5('42:' || entry_no), entry_no) as pos, count(*) over (partition by {s}) as size"
_S = ", ".join(STRATA)
_QUOTA = "greatest(1, round_even({n} * {r}, 0))"


def _with_articles(body: str, extra: str = "") -> str:
    return f"with {SQL_ARTICLES}{', ' + extra if extra else ''} {body}"


@R.add(
    _with_articles(
        f"""select entry_no, case when size < 3 then 'train' when pos <= {_QUOTA.format(n='size', r=0.15)} then 'test' when pos <= 2 * {_QUOTA.format(n='size', r=0.15)} then 'val' else 'train' end as split
  from (select entry_no, {_POS.format(s=_S)} from art)"""
    )
)
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified split by source, decision and format."""
    return split.stratified_split(bind.articles(spark, sf_dir).select("entry_no", *STRATA), "entry_no", STRATA)


@R.add(
    _with_articles(
        f"""select entry_no, 'test' as split from art where split = 'test' union all
  select entry_no, case when size >= 2 and pos <= {_QUOTA.format(n='size', r=0.15)} then 'val' else 'train' end from (select entry_no, {_POS.format(s=_S)} from art where split is null or split <> 'test')"""
    )
)
def split_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split that keeps the stored test set."""
    a = bind.articles(spark, sf_dir).select("entry_no", "split", *STRATA)
    return split.frozen_split(a.drop("split"), "entry_no", STRATA, a.where("split = 'test'").select("entry_no"))


_QUOTAS = {"elife": 20, "f1000": 30, "nature": 5, "peerj": 15, "plos": 20}


@R.add(
    _with_articles(
        f"""select entry_no, case when pos <= t then 'test' when size - t >= 2 and pos <= t + {_QUOTA.format(n='(size - t)', r=0.15)} then 'val' else 'train' end as split from (
  select *, least(coalesce(case source {' '.join(f"when '{k}' then {v}" for k, v in _QUOTAS.items())} end, 0), size) as t from (select entry_no, source, {_POS.format(s='source')} from art))"""
    )
)
def split_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split with exact test counts per source."""
    return split.balanced_test(bind.articles(spark, sf_dir).select("entry_no", "source"), "entry_no", "source", _QUOTAS)


@R.add(
    _with_articles(
        """select entry_no, case when n = 0 then review_format || ':no_concerns' else review_format || ':' ||
    (case when nr / n >= 0.8 then 'high_noresp' when nc / n >= 0.3 then 'high_concede' else 'mixed' end) || ':' ||
    (case when coalesce(len(subjects), 0) = 0 then 'unknown' when contains(lower(subjects[1]), 'neuro') then 'neuro' when contains(lower(subjects[1]), 'cell') then 'cell' else 'other' end) end as stratum
  from (select a.entry_no, review_format, subjects, coalesce(c.n, 0) as n, c.nr, c.nc from art a left join (
    select entry_no, count(*)::double as n, count(*) filter (author_stance = 'no_response') as nr, count(*) filter (author_stance = 'conceded') as nc from concerns group by 1) c using (entry_no))"""
    )
)
def split_legacy_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratum of the older splitter: format, stances, first subject."""
    c = table(spark, sf_dir, "concerns").groupBy("entry_no").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.coalesce("author_stance", F.lit(""))).alias("stances"))
    a = bind.articles(spark, sf_dir).select("entry_no", "review_format", "subjects").join(c, "entry_no", "left")
    return a.select("entry_no", split.legacy_stratum(F.col("n"), F.col("stances"), F.col("review_format"), F.col("subjects")).alias("stratum"))


@R.add(_with_articles("select source, n, n / sum(n) over () as share, n / sum(n) over () > 0.5 as dominant from (select source, count(*) as n from art group by 1)"))
def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.source_balance(bind.articles(spark, sf_dir), "source")


SUBSET = 60
_SUBSET_STRATA = ["split", "source", "review_format", "has_author_response"]


@R.add(
    _with_articles(
        f"""select entry_no, p.split, p.source, p.review_format, p.has_author_response from pos p join got g on p.split is not distinct from g.split and p.source = g.source and p.review_format = g.review_format
    and p.has_author_response is not distinct from g.has_author_response where pos <= got""",
        f"""pos as (select entry_no, {', '.join(_SUBSET_STRATA)}, {_POS.format(s=', '.join(_SUBSET_STRATA))} from art),
s1 as (select {', '.join(_SUBSET_STRATA)}, count(*) as size, concat_ws('|', coalesce(split, '~'), source, review_format, coalesce(has_author_response::varchar, '~')) as name from art group by all),
s2 as (select *, count(*) over () as k, sum(size - 1) over () as pool from s1),
s3 as (select *, case when k <= {SUBSET} and pool > 0 then ({SUBSET} - k) * (size - 1)::double / pool else 0 end as share from s2),
s4 as (select *, least(floor(share), size - 1) as extra, share - floor(share) as frac from s3),
s5 as (select *, sum(extra + 1) over () as used, row_number() over (order by (size > extra + 1) desc, frac desc, name desc) as more, row_number() over (order by size desc, name) as first from s4),
got as (select *, case when k > {SUBSET} then (first <= {SUBSET})::int else extra + 1 + (more <= {SUBSET} - used and size > extra + 1)::int end as got from s5)""",
    )
)
def human_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty articles, one per stratum at least, the rest by largest remainder."""
    return split.largest_remainder(bind.articles(spark, sf_dir).select("entry_no", *_SUBSET_STRATA), "entry_no", _SUBSET_STRATA, SUBSET)


@R.add(
    """with recursive st as (select coalesce(category, '~') as c, coalesce(severity, '~') as s, count(*) as size from concerns group by 1, 2),
o as (select list(size order by c, s) as sizes, count(*)::int as k, sum(size)::double as total from st),
r as (
  select 0 as step, list_transform(sizes, lambda x: 1::bigint) as got from o
  union all
  select step + 1, list_transform(got, lambda g, i: case when i = best.j then g + 1 else g end) from (
    select step, got, list_sort(list_transform(list_filter(range(1, k + 1), lambda j: got[j] < sizes[j]), lambda j: {'a': -(80 * sizes[j] / total - got[j]), 'b': -(sizes[j] - got[j]), 'j': j}))[1] as best
    from r, o where step < least(80, total) - k)
),
g as (select got from r order by step desc limit 1),
places as (select c, s, g.got[k] as n from (select c, s, row_number() over (order by c, s) as k from st), g)
select concern_no, c as category, s as severity from (
  select concern_no, coalesce(category, '~') as c, coalesce(severity, '~') as s, row_number() over (partition by coalesce(category, '~'), coalesce(severity, '~') order by md5('42:' || concern_no), concern_no) as pos from concerns
) join places using (c, s) where pos <= n"""
)
def pack_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rater pack of 80 concerns, by largest deficit per category and severity."""
    return split.pack_sample(table(spark, sf_dir, "concerns").select("concern_no", "category", "severity"), "concern_no", ["category", "severity"], 80)


@R.add("select id, min(entry_no) as entry_no, arg_min(title, entry_no) as title from articles group by id")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each id in load order."""
    return split.first_wins(table(spark, sf_dir, "articles").select("entry_no", "id", "title"), "id", ["entry_no"]).select("id", "entry_no", "title")


@R.add(
    r"""select entry_no from articles a where not regexp_matches(coalesce(title, ''), '^(correction|erratum|retraction|corrigendum)[\s:]', 'i') and exists (select 1 from concerns c where c.entry_no = a.entry_no)"""
)
def usable_noncorrection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are no notices and have concerns."""
    a = table(spark, sf_dir, "articles").where(~F.coalesce("title", F.lit("")).rlike(T.NOTICE_TITLE)).select("entry_no")
    return a.join(table(spark, sf_dir, "concerns").select("entry_no"), "entry_no", "left_semi")


_DOI = r"""nullif(regexp_extract(regexp_replace(replace(regexp_replace(lower(doi), '[\s\x{00A0}\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '%2f', '/'), '[\x{2010}-\x{2015}\x{2212}]', '-', 'g'), '(10\.[0-9]{4,9}/.*[^\s./,;:)\]])', 1), '')"""


@R.add(
    _with_articles(
        f"""select doi, n_rows, array_to_string(s, '+') as sources from (
  select doi, count(*) as n_rows, list_sort(list_distinct(list(source))) as s from (select {_DOI} as doi, source from art) where doi is not null and not starts_with(doi, '10.0000/') group by 1) where len(s) > 1"""
    )
)
def cross_source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs, in one spelling, that several sources list."""
    return profile.cross_source_duplicates(bind.articles(spark, sf_dir), canonical_doi(F.col("doi")))


@R.add(
    _with_articles(
        """select split, field, value, count(*) as n from (
  select coalesce(split, 'unassigned') as split, unnest(['articles', 'source', 'decision', 'format', 'response']) as field,
    unnest(['all', source, editorial_decision, review_format, coalesce(has_author_response, false)::varchar]) as value from art
  union all select coalesce(a.split, 'unassigned'), unnest(['concerns', 'severity', 'category', 'stance']), unnest(['all', c.severity, c.category, c.author_stance]) from concerns c join art a using (entry_no)
) group by grouping sets ((split, field, value), (field, value))"""
    )
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, concerns and their distributions per split and in all."""
    a = bind.articles(spark, sf_dir)
    c = table(spark, sf_dir, "concerns").select("entry_no", "severity", "category", "author_stance").join(a.select("entry_no", "split"), "entry_no")
    return profile.split_summary(a, c)


@R.add("select coalesce(category, 'unknown') as value, count(*) as n, count(*) * 100.0::double / (select count(*) from concerns) as percent from concerns group by 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of concerns with counts and percentages."""
    return profile.distribution(table(spark, sf_dir, "concerns"), "category")


@R.add(
    _with_articles(
        """select source, count(*) as n, round(avg(k), 9) as mean, median(k)::double as median, round(coalesce(stddev_samp(k), 0), 9) as stdev, min(k) as least, max(k) as most, sum(k)::bigint as total
  from (select a.source, a.entry_no, count(c.concern_no) as k from art a left join concerns c using (entry_no) group by 1, 2) group by 1"""
    )
)
def count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns per article: mean, median, deviation and extremes by source."""
    n = table(spark, sf_dir, "concerns").groupBy("entry_no").agg(F.count(F.lit(1)).alias("k"))
    a = bind.articles(spark, sf_dir).select("entry_no", "source").join(n, "entry_no", "left").na.fill(0, ["k"])
    out = profile.count_stats(a, "source", "k")
    return out.withColumns({"mean": F.round("mean", 9), "stdev": F.round("stdev", 9)})


@R.add("select author_stance, least(greatest(floor(resolution_confidence * 30), 0), 29)::int as bin, count(*) as n from concerns where resolution_confidence is not null group by 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty bins of the resolution confidence per stance."""
    return profile.histogram(table(spark, sf_dir, "concerns").where("resolution_confidence is not null"), ["author_stance"], "resolution_confidence")


@R.add("select author_stance, list_sort(list(resolution_confidence))[count(*) // 2 + 1] as upper_median from concerns where resolution_confidence is not null group by 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the resolution confidence per stance."""
    return profile.upper_median(table(spark, sf_dir, "concerns").where("resolution_confidence is not null"), ["author_stance"], "resolution_confidence")


@R.add("select entry_no, arg_min(category, (-n, category)) as dominant from (select entry_no, category, count(*) as n from concerns where category is not null group by 1, 2) group by 1".replace("arg_min(category, (-n, category))", "list_sort(list((-n, category)))[1][2]"))
def dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent category of each article's concerns."""
    return profile.dominant_label(table(spark, sf_dir, "concerns"), "entry_no", "category")


_PRICES = {"small": (0.25, 1.25), "large": (3.0, 15.0)}  # per million tokens in and out; by exact name, else by the longest name it begins with


@R.add(
    _with_articles(
        """select source, n, tokens, n * 1500 as output_tokens, (tokens * 0.25 + n * 1500 * 1.25) / 1e6 as cost from (
  select source, count(*) as n, floor(sum(least(length(coalesce(title, '')) + length(coalesce(abstract, '')) + coalesce(list_sum(list_transform(map_values(paper_text_sections), lambda x: length(coalesce(x, '')))), 0), 80000)) / 4)::bigint as tokens from art group by 1)"""
    )
)
def input_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and cost of whole articles by source, 80,000 characters an article at most (the limit of a prompt)."""
    chars = profile.article_chars(F.col("title"), F.col("abstract"), F.col("paper_text_sections"))
    price_in, price_out = profile.price_of("small-2", _PRICES, _PRICES["large"])
    return profile.input_cost(bind.articles(spark, sf_dir), chars, 80_000, price_in, price_out, "source")


@R.add(
    _with_articles(
        """select a.id, a.source, a.split, a.published_date, a.has_author_response, coalesce(c.n, 0) as n_concerns from art a left join (select entry_no, count(*) as n from concerns group by 1) c using (entry_no)"""
    )
)
def export_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with nested concerns, flattened to their number for comparison."""
    a, c = bind.articles(spark, sf_dir), table(spark, sf_dir, "concerns").withColumnRenamed("source", "concern_source")
    n = export.nested(a, c, ["concern_text", "category", "severity"])
    return n.select("id", "source", "split", "published_date", "has_author_response", F.size("concerns").cast("bigint").alias("n_concerns"))


@R.add(
    _with_articles(
        """select a.id, a.split, case when a.split = 'test' then '' else coalesce(c.texts, '') end as texts, case when a.split = 'test' then 0 else coalesce(c.n, 0) end as n_concerns
  from art a left join (select entry_no, count(*) as n, string_agg(category || ':' || severity, ',' order by concern_no) as texts from concerns group by 1) c using (entry_no)"""
    )
)
def export_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark view: test articles show no concerns."""
    a, c = bind.articles(spark, sf_dir), table(spark, sf_dir, "concerns")
    b = export.benchmark_view(export.nested(a, c, ["concern_text", "category", "severity"]))
    label = F.transform("concerns", lambda x: F.concat(x["category"], F.lit(":"), x["severity"]))
    return b.select("id", "split", F.array_join(label, ",").alias("texts"), F.size("concerns").cast("bigint").alias("n_concerns"))


@R.add(
    _with_articles(
        """select a.id as article_id, a.doi, a.source, a.title, a.published_date, a.editorial_decision, c.concern_id, c.reviewer_num, c.concern_text, c.category, c.severity, c.author_response_text, c.author_stance,
    c.evidence_of_change, c.resolution_confidence, c.was_valid, c.raised_by_multiple, c.requires_figure_reading, c.article_doi from concerns c join art a using (entry_no)"""
    )
)
def concerns_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per concern with its article's fields."""
    c = table(spark, sf_dir, "concerns")
    return export.concerns_flat(bind.articles(spark, sf_dir), c).drop("abstract", "paper_text_sections")


@R.add(
    _with_articles(
        "select id as article_id, doi, source as journal, title, abstract, array_to_string(list_sort(map_keys(paper_text_sections)), '|') as sections, list_sum(list_transform(map_values(paper_text_sections), lambda x: length(x)))::bigint as section_chars, 0 as n_references from art"
    )
)
def task_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a system under test may see; of the sections their names and total length are compared."""
    t = export.task_input(bind.articles(spark, sf_dir))
    chars = F.aggregate(F.map_values("sections"), F.lit(None).cast("bigint"), lambda a, x: F.when(x.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + F.length(x)))
    names = F.array_join(F.array_sort(F.map_keys("sections")), "|")
    return t.select("article_id", "doi", "journal", "title", "abstract", names.alias("sections"), chars.alias("section_chars"), F.size("references").alias("n_references"))


@R.add(_with_articles("select id, source, doi, published_date, schema_version from art"))
def public_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.public_index(bind.articles(spark, sf_dir))


@R.add(_with_articles("select a.id as article_id, a.source, c.concern_id, c.category, c.severity, c.author_stance from concerns c join art a using (entry_no) where a.split is distinct from 'test'"))
def public_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.public_annotations(bind.articles(spark, sf_dir), table(spark, sf_dir, "concerns"))


def _unsafe(c: str, most: int) -> str:
    return f"case when {c} is null then 'missing' when regexp_matches({c}, '\\pC') then 'control characters' when contains({c}, '@') then 'e-mail-like' when regexp_matches({c}, '[\\s\\pZ]') then 'white space' when {c} = '' or length({c}) > {most} then 'length' end"


_SHAPES = " or ".join(f"(lower(source) = '{s}' and regexp_full_match(id, '{p}'))" for s, p in export.ARTICLE_IDS.items())
_SOURCES = ", ".join(f"'{s}'" for s in export.SOURCES)


@R.add(
    f"""select * from (
  select id, 'id' as field, coalesce({_unsafe('id', 128)}, case when not starts_with(id, lower(source) || ':') then 'id does not belong to source' end, case when not ({_SHAPES}) then 'no id of its source' end) as reason from articles
  union all select id, 'source', coalesce({_unsafe('source', 16)}, case when source not in ({_SOURCES}) then 'unknown source' end) from articles
  union all select id, 'doi', coalesce({_unsafe('doi', 255)}, case when not regexp_full_match(doi, '{export.DOI_SHAPE}') then 'no DOI' end) from articles
  union all select id, 'published_date', coalesce({_unsafe('published_date', 10)}, case when not regexp_full_match(published_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(published_date as date) is null then 'no ISO date' end) from articles
  union all select id, 'schema_version', coalesce({_unsafe('schema_version', 16)}, case when schema_version <> '1.1' then 'other version' end) from articles
) where reason is not null"""
)
def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the raw index that may not be published, with the reason."""
    return export.index_violations(export.public_index(table(spark, sf_dir, "articles")))


@R.add(
    r"""select concern_no, case when regexp_matches(concern_text, '\pC') then 'control characters' when contains(concern_text, '@') then 'e-mail-like' else 'length' end as reason
  from concerns where concern_text is not null and (regexp_matches(concern_text, '\pC') or contains(concern_text, '@') or concern_text = '' or length(concern_text) > 200)"""
)
def safe_string_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concern texts that are no safe short strings."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null")
    return c.select("concern_no", export.unsafe_reason(F.col("concern_text"), 200).alias("reason")).where("reason is not null")


@R.add(
    _with_articles(
        r"""select entry_no, field, severity from (select entry_no, unnest(list_filter([
  case when not regexp_matches(coalesce(id, ''), '^[a-z0-9_]+:.+$') then 'id/error' end, case when split_part(id, ':', 1) is distinct from source then 'source/error' end,
  case when not starts_with(coalesce(doi, ''), '10.') then 'doi/error' end, case when trim(coalesce(title, '')) = '' then 'title/error' end,
  case when length(coalesce(abstract, '')) < 50 then 'abstract/error' end, case when coalesce(cardinality(paper_text_sections), 0) < 1 then 'paper_text_sections/error' end,
  case when editorial_decision = 'unknown' then 'editorial_decision/warning' end, case when trim(coalesce(extraction_manifest_id, '')) = '' then 'extraction_manifest_id/warning' end], lambda x: x is not null)) as v from art),
  lateral (select split_part(v, '/', 1) as field, split_part(v, '/', 2) as severity)"""
    )
)
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of articles."""
    return validate.article_issues(bind.articles(spark, sf_dir))


@R.add(
    r"""with c as (select *, min(concern_no) over (partition by entry_no, concern_id) as first, length(coalesce(concern_text, '')) as n from concerns)
select concern_no, split_part(v, '/', 1) as field, split_part(v, '/', 2) as severity from (select concern_no, unnest(list_filter([
  case when concern_id is not null and concern_no > first then 'concern_id/error' end, case when resolution is not null and resolution is distinct from author_stance then 'resolution/error' end,
  case when was_valid is not null and was_valid <> (coalesce(author_stance in ('conceded', 'partial'), false) and evidence_of_change is distinct from false) then 'was_valid/warning' end,
  case when resolution_confidence not between 0 and 1 then 'resolution_confidence/error' end, case when n < 10 or n > 2000 then 'concern_text/error' end,
  case when trim(coalesce(extraction_trace_id, '')) = '' then 'extraction_trace_id/warning' end], lambda x: x is not null)) as v from c)"""
)
def concern_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of concerns."""
    return validate.concern_issues(table(spark, sf_dir, "concerns"))


_RATERS = f"""last as (select concern_no, annotator_id, {sql_category('severity')} as severity, {sql_category('category')} as category, {sql_category('author_stance')} as stance from (
    select *, row_number() over (partition by concern_no, annotator_id order by labelled_at desc, label_no desc) as k from concern_labels) where k = 1),
ends as (select concern_no, min(annotator_id) as first, max(annotator_id) as last from last group by 1 having min(annotator_id) <> max(annotator_id)),
pairs as (select e.*, x.stance as a, y.stance as b, x.category as ca, y.category as cb from ends e join last x on x.concern_no = e.concern_no and x.annotator_id = e.first join last y on y.concern_no = e.concern_no and y.annotator_id = e.last),
p as (select p.*, c.source from pairs p join concerns c using (concern_no) where a is not null and b is not null)"""


def _rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters per concern, the first and the last annotator by name, each with the latest answer."""
    from peerlume.functions.keys import category

    lab = table(spark, sf_dir, "concern_labels").select("concern_no", "annotator_id", "labelled_at", "label_no", category(F.col("author_stance")).alias("stance"), category(F.col("category")).alias("category"))
    last = lab.groupBy("concern_no", "annotator_id").agg(F.max_by(F.struct("stance", "category"), F.struct("labelled_at", "label_no")).alias("v"))
    ends = last.groupBy("concern_no").agg(
        F.min("annotator_id").alias("first"), F.max("annotator_id").alias("last"), F.min_by("v", "annotator_id").alias("x"), F.max_by("v", "annotator_id").alias("y")
    )
    p = ends.where("first <> last").select("concern_no", "first", "last", F.col("x.stance").alias("a"), F.col("y.stance").alias("b"), F.col("x.category").alias("ca"), F.col("y.category").alias("cb"))
    return p.join(table(spark, sf_dir, "concerns").select("concern_no", "source"), "concern_no").where("a is not null and b is not null")


def _sql_kappa(group: str, labels: str, undefined: str, least: int) -> str:
    return f"""select {group}, n, round(observed, 9) as observed, round(expected, 9) as expected, case when expected < 1 - 1e-12 and n >= {least} then round((observed - expected) / (1 - expected), 9) else {undefined} end as kappa from (
  select n.{group}, n, observed, coalesce(products, 0) / (n * n) as expected from (select {group}, count(*)::double as n, avg((a = b)::int) as observed from p group by 1) n
  left join (select x.{group}, sum(na::double * nb) as products from (select {group}, a as label, count(*) as na from p group by 1, 2) x join (select {group}, b as label, count(*) as nb from p group by 1, 2) y
    on x.{group} is not distinct from y.{group} and x.label = y.label {labels} group by 1) c on c.{group} is not distinct from n.{group})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.col("n").cast("double")).withColumns({c: F.round(c, 9) for c in ("observed", "expected", "kappa")})


@R.add(f"with {_RATERS} {_sql_kappa('source', '''and x.label in ('conceded', 'rebutted', 'partial', 'unclear', 'no_response')''', '0.0', 1)}")
def kappa_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of two raters on stances, chance over the five fixed stances, 0 where undefined, per source."""
    return _rounded(validate.kappa(_rater_pairs(spark, sf_dir), ["source"], labels=list(export.STANCES), undefined=0.0))


@R.add(f"with {_RATERS} {_sql_kappa('source', '', 'null', 2)}")
def kappa_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa over all labels seen, NULL where undefined, per source."""
    return _rounded(validate.kappa(_rater_pairs(spark, sf_dir), ["source"]))


@R.add(f"with {_RATERS} select ca as category, count(*) as n, count(*) filter (a = b) as n_same, {sql_ratio('count(*) filter (a = b)', 'count(*)')} as agreement from p group by 1")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement on stances by the first rater's category."""
    return validate.label_agreement(_rater_pairs(spark, sf_dir).withColumnRenamed("ca", "category"), "category")


@R.add(f"with {_RATERS} select first, last, count(*) as n, count(*) filter (a = b) as n_exact, {sql_ratio('count(*) filter (a = b)', 'count(*)')} as exact_fraction, count(*) >= 20 and count(*) filter (a = b) = count(*) as suspicious from p group by 1, 2")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of raters that agree too well."""
    return validate.identity_check(_rater_pairs(spark, sf_dir), ["first", "last"])


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


_T = "lower(coalesce(text, ''))"


@R.add(f"select doc_id, case when {_any(_T, T.MAJOR_PHRASES)} then 'major_revision' when {_any(_T, T.MINOR_PHRASES)} then 'minor_revision' when contains({_T}, 'accept') and not contains({_T}, 'revision') then 'accept' when contains({_T}, 'reject') then 'reject' else 'unknown' end as decision from documents")
def decision_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision that each document's text states."""
    return table(spark, sf_dir, "documents").select("doc_id", T.decision_of_letter(F.col("text")).alias("decision"))


@R.add(f"select doc_id, case when coalesce(text, '') = '' then 'unknown' when {_any(_T, T.PREPRINT_PHRASES)} then 'reviewed_preprint' when {_any(_T, T.JOURNAL_PHRASES)} then 'journal' when year(fetched_at) <= 2022 then 'journal' when year(fetched_at) >= 2024 then 'reviewed_preprint' else 'unknown' end as review_format from documents")
def review_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review format of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.format_of_letter(F.col("text"), F.col("fetched_at")).alias("review_format"))


def _words(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STANCE_STOPWORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: length(w) >= 4 and w not in ({stop})))"


@R.add(
    f"""with c as (select concern_no, author_stance, {_words('concern_text')} as kw, list_filter(regexp_split_to_array(regexp_replace(coalesce(author_response_text, ''), '([.!?])\\s+', '\\1\x01', 'g'), '\x01|\\n\\s*\\n'), lambda x: length(trim(x)) > 0) as chunks from concerns),
k as (select concern_no, i, lower(chunks[i]) as ch, kw from c, unnest(range(1, len(chunks) + 1)) t(i) where author_stance = 'unclear'),
v as (select concern_no, i, case when {_any('ch', T.AGREE_PHRASES)} then 'conceded' when {_any('ch', T.DISAGREE_PHRASES)} then 'rebutted' end as verdict from k where len(kw) > 0 and len(list_intersect(kw, {_words('ch')})) >= least(len(kw), 2))
select c.concern_no, coalesce(f.verdict, c.author_stance) as stance from c left join (select concern_no, arg_min(verdict, i) as verdict from v where verdict is not null group by 1) f using (concern_no)"""
)
def stance_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance of each concern, unclear ones decided by the response where it speaks of the concern."""
    c = table(spark, sf_dir, "concerns")
    return c.select("concern_no", T.fixed_stance(F.col("concern_text"), F.col("author_response_text"), F.col("author_stance")).alias("stance"))


@R.add(
    r"""select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g')) as visible from documents where regexp_matches(text, '</[a-zA-Z]')"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of documents with markup."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("</[a-zA-Z]"))
    return d.select("doc_id", T.html_text(F.col("text")).alias("visible"))


@R.add(
    _with_articles(
        r"""select entry_no, coalesce(nullif(case when regexp_matches(split_part(d, 'T', 1), '^[0-9]{4}$') then split_part(d, 'T', 1) || '-01-01' else split_part(d, 'T', 1) end, ''), null) as day,
  family, len(list_filter(subjects, lambda s: s not in ('Research Article', 'Research Advance', 'Insight', 'Correction', 'Short Report', 'Review Article', 'Tools and Resources', 'Feature Article', 'Editorial', 'Registered Report', 'Replication Study', 'Scientific Correspondence', 'Cell Press Exclusive'))) as n_subjects
  from (select *, nullif(trim(published_date), '') as d, nullif(case when source = 'f1000' then regexp_extract(lower(trim(doi)), '^(10\.12688/f1000research\.[^.]+)\.[0-9]+$', 1) end, '') as family from art)"""
    )
)
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised date, manuscript family and number of real subjects of each article."""
    a = bind.articles(spark, sf_dir)
    n = F.size(T.clean_subjects(F.col("subjects")))
    return a.select("entry_no", T.normalized_date(F.col("published_date")).alias("day"), T.f1000_family(F.col("source"), F.col("doi")).alias("family"), F.when(F.col("subjects").isNotNull(), n).cast("bigint").alias("n_subjects"))


@R.add(
    r"""select concern_no, coalesce(author_stance in ('conceded', 'partial'), false) and evidence_of_change is distinct from false as valid,
  case when regexp_matches(trim(coalesce(article_doi, '')), 'elife\.[0-9]+', 'i') then regexp_extract(lower(trim(article_doi)), 'elife\.([0-9]+)', 1)
    when s <> '' then left(s, 64) else 'unknown' end as token
  from (select *, regexp_replace(regexp_replace(case when contains(trim(coalesce(article_doi, '')), '/') then regexp_replace(trim(article_doi), '^[^/]*/', '') else trim(coalesce(article_doi, '')) end, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-_.]+|[-_.]+$', '', 'g') as s from concerns)"""
)
def concern_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and id token of each concern."""
    c = table(spark, sf_dir, "concerns")
    return c.select("concern_no", T.was_valid(F.col("author_stance"), F.col("evidence_of_change")).alias("valid"), T.doi_token(F.col("article_doi")).alias("token"))
