"""Queries on field functions, validators, rater files, samples and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions import text as T
from peerlume.operators import export, match, metrics, profile, split, stats, validate
from peerlume.plans import bind
from peerlume.plans.bind import SQL_ARTICLES, SQL_MATCHING, sql_category, sql_ratio, sql_scores
from peerlume.plans.evaluation import matching
from peerlume.plans.registry import Registry
from peerlume.session import materialised, shared_table_path, table
from peerlume.sources import readers

R = Registry()


def _with_articles(body: str, extra: str = "") -> str:
    return f"with {SQL_ARTICLES}{', ' + extra if extra else ''} {body}"


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


# --- functions of fields ---------------------------------------------------------------------------

_DAY = "case when regexp_full_match(split_part(trim(published_date), 'T', 1), '[0-9]{4}') then split_part(trim(published_date), 'T', 1) || '-01-01' else split_part(trim(published_date), 'T', 1) end"


@R.add(
    f"""select entry_no, day, printf('%04d-%02d-%02d', year(collected_at), month(collected_at), 1) as collected, coalesce(day >= date '2021-06-01', true) and coalesce(day <= date '2023-12-31', true) as in_range
  from (select *, case when regexp_full_match({_DAY}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({_DAY} as date) end as day from articles)"""
)
def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published dates parsed, months padded, and a range that unknown dates belong to."""
    a = table(spark, sf_dir, "articles").withColumn("day", T.parsed_date(F.col("published_date")))
    inside = T.in_date_range(F.col("day"), F.lit("2021-06-01").cast("date"), F.lit("2023-12-31").cast("date"))
    return a.select("entry_no", "day", T.padded_date(F.year("collected_at"), F.month("collected_at"), F.lit(None).cast("int")).alias("collected"), inside.alias("in_range"))


_SECTION = " ".join(f"when contains(t, '{part}') then '{key}'" for part, key in T.SECTION_KEYS)


@R.add(
    f"""select title, case {_SECTION} when s <> '' then s else 'section' end as key, n from (
  select title, n, t, left(regexp_replace(t, '[^a-z0-9_]', '_', 'g'), 40) as s from (
    select title, count(*) as n, regexp_replace(trim(lower(title)), '\\.+$', '') as t from (select unnest(map_keys(paper_text_sections)) as title from articles union all select unnest(subjects) from articles) group by 1)) where title is not null"""
)
def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard keys of section titles, and of subjects as titles that stand for nothing."""
    a = table(spark, sf_dir, "articles")
    titles = a.select(F.explode(F.map_keys("paper_text_sections")).alias("title")).unionByName(a.select(F.explode("subjects").alias("title")))
    n = titles.where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return n.select("title", T.section_key(F.col("title")).alias("key"), "n")


@R.add(
    r"""select concern_no, coalesce(length(trim(author_response_text)) <= 300 and regexp_matches(trim(author_response_text), '(?i)submitted\s+filename|attachment\s*:|\.(docx|pdf|doc|txt)\b'), false) as attachment,
  case when lower(evidence_of_change::varchar) = 'true' then true when lower(evidence_of_change::varchar) = 'false' then false end as evidence, case reviewer_num when 1 then true when 0 then false end as first_reviewer,
  coalesce(regexp_matches(concern_text, '""" + T.TRUNCATION.replace("'", "''") + r"""'), false) as artifact from concerns"""
)
def response_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that only name a file, loosely typed flags, and concerns about truncated input."""
    c = table(spark, sf_dir, "concerns")
    return c.select(
        "concern_no", F.coalesce(T.is_attachment_only(F.col("author_response_text")), F.lit(False)).alias("attachment"), T.evidence_flag(F.col("evidence_of_change")).alias("evidence"),
        T.evidence_flag(F.col("reviewer_num")).alias("first_reviewer"), T.is_truncation_artifact(F.col("concern_text")).alias("artifact"),
    )


@R.add(
    r"""select concern_no, source || ':' || token || ':R' || reviewer_num || 'C' || place as built from (
  select concern_no, source, reviewer_num, row_number() over (partition by entry_no, reviewer_num order by concern_no) as place,
    case when regexp_matches(trim(coalesce(article_doi, '')), 'elife\.[0-9]+', 'i') then regexp_extract(lower(trim(article_doi)), 'elife\.([0-9]+)', 1) when s <> '' then left(s, 64) else 'unknown' end as token
  from (select *, regexp_replace(regexp_replace(case when contains(trim(coalesce(article_doi, '')), '/') then regexp_replace(trim(article_doi), '^[^/]*/', '') else trim(coalesce(article_doi, '')) end, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-_.]+|[-_.]+$', '', 'g') as s from concerns))"""
)
def built_concern_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of concerns from source, DOI, reviewer and place among the reviewer's concerns."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("entry_no", "reviewer_num").orderBy("concern_no"))  # one reviewer of one article
    c = table(spark, sf_dir, "concerns").withColumn("place", place)
    return c.select("concern_no", T.concern_id(F.col("source"), F.col("article_doi"), F.col("reviewer_num"), F.col("place")).alias("built"))


_HOSTS = " ".join(f"when '{k}' then '{v}'" for k, v in T.XML_HOSTS.items())


@R.add(
    rf"""select entry_no, 'https://' || case regexp_extract(low, '{{p}}', 1) {_HOSTS} end || '/articles/' || regexp_extract(low, '{{p}}', 2) || '/' || regexp_extract(low, '{{p}}', 3) || '/xml' as url,
  case when contains(doi, '/') then list_reverse(string_split(low, '/'))[1] end as token, coalesce(len(string_split(doi, '/')) <= 2, false) as is_root, replace(trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')), ' ', '_') as journal,
  trim(regexp_replace(abstract, '<[^>]+>', '', 'g')) as plain from (select *, lower(doi) as low from articles)""".replace("{p}", r"10\.12688/([a-z0-9]+)\.(\d+)\.(\d+)")
)
def doi_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the XML of a DOI lies, its token and depth, the journal's key, and abstracts without tags."""
    a = table(spark, sf_dir, "articles")
    doi = F.col("doi")
    return a.select("entry_no", T.xml_url(doi).alias("url"), T.article_token(doi).alias("token"), T.is_root_doi(doi).alias("is_root"), T.journal_key(F.col("source")).alias("journal"), T.without_tags(F.col("abstract")).alias("plain"))


@R.add(
    f"""select doc_id, coalesce(regexp_matches(left(text, 3000), '{T.REVIEW_WORDS}'), false) as speaks, length(text) as n from documents"""
)
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose beginning speaks of a peer review."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.speaks_of_review(F.col("text")).alias("speaks"), F.length("text").alias("n"))


@R.add(
    """select source, n, case when n < 1000 then 'n<1K' when n < 10000 then '1K<n<10K' when n < 100000 then '10K<n<100K' else '100K<n<1M' end as size_label,
  case when mean < 0.2 then 'Poor' when mean < 0.4 then 'Fair' when mean < 0.6 then 'Moderate' when mean < 0.8 then 'Substantial' else 'Almost perfect' end as mean_label,
  '1.' || (n % 10 + 1) as next_minor, (n % 10 + 1) || '.0' as next_major from (select source, count(*) as n, coalesce(avg(resolution_confidence), 0) as mean from concerns group by 1)"""
)
def labels_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and agreement labels, and versions bumped."""
    c = table(spark, sf_dir, "concerns").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("resolution_confidence"), F.lit(0.0)).alias("mean"))
    last = (F.col("n") % 10).cast("string")
    return c.select(
        "source", "n", T.size_category(F.col("n")).alias("size_label"), T.kappa_label(F.col("mean")).alias("mean_label"),
        T.bumped_version(F.concat(F.lit("1."), last)).alias("next_minor"), T.bumped_version(F.concat(last, F.lit(".7")), major=True).alias("next_major"),
    )


# --- projections and validators --------------------------------------------------------------------


@R.add(_with_articles("select source, id, entry_no, published_date from art where source = 'peerj'"))
def peerj_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of one source's articles, four of them compared."""
    return export.source_subset(bind.articles(spark, sf_dir), "peerj").select("source", "id", "entry_no", "published_date")


_LABELS = ", ".join(f"'{x}'" for x in T.ARTICLE_TYPE_LABELS)
_FORMAT = f"""case when coalesce(letter, '') = '' then 'unknown' when {_any('lower(letter)', T.PREPRINT_PHRASES)} then 'reviewed_preprint' when {_any('lower(letter)', T.JOURNAL_PHRASES)} then 'journal'
  when try_cast(regexp_extract(published_date, '^([0-9]{{4}})', 1) as int) <= 2022 then 'journal' when try_cast(regexp_extract(published_date, '^([0-9]{{4}})', 1) as int) >= 2024 then 'reviewed_preprint' else 'unknown' end"""
_LETTERS = "letters as (select entry_no, string_agg(concern_text, ' ' order by concern_no) as letter, string_agg(author_response_text, ' ' order by concern_no) as response from concerns group by 1)"


@R.add(
    _with_articles(
        f"""select entry_no, len(list_filter(subjects, lambda s: s not in ({_LABELS}))) as n_subjects, case when review_format = 'unknown' then {_FORMAT} else review_format end as review_format,
  trim(coalesce(response, '')) <> '' as has_author_response, '1.1' as schema_version from art left join letters using (entry_no)""",
        _LETTERS,
    )
)
def postprocessed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as they are kept, with letters put together from their concerns."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("concern_no", c)))), lambda x: x[c]), " ")
    some = lambda c: F.when(F.count(c) > 0, joined(c))
    letters = table(spark, sf_dir, "concerns").groupBy("entry_no").agg(some("concern_text").alias("letter"), some("author_response_text").alias("response"))
    p = export.postprocessed(bind.articles(spark, sf_dir).join(letters, "entry_no", "left"), "letter", "response")
    return p.select("entry_no", F.when(F.col("subjects").isNotNull(), F.size("subjects")).cast("bigint").alias("n_subjects"), "review_format", "has_author_response", "schema_version")


_DECISION = f"""case when {_any('low', T.MAJOR_PHRASES)} then 'major_revision' when {_any('low', T.MINOR_PHRASES)} then 'minor_revision' when contains(low, 'accept') and not contains(low, 'revision') then 'accept' when contains(low, 'reject') then 'reject' else 'unknown' end"""


@R.add(_with_articles(f"select old, new, count(*) as n from (select editorial_decision as old, case when editorial_decision = 'unknown' and low <> '' then {_DECISION} else editorial_decision end as new from (select a.*, lower(coalesce(letter, '')) as low from art a left join letters using (entry_no))) group by 1, 2", _LETTERS))
def decision_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions inferred again where they are unknown and there is a letter, counted by change."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("concern_text").isNotNull(), F.struct("concern_no", "concern_text")))), lambda x: x["concern_text"]), " ")
    letters = table(spark, sf_dir, "concerns").groupBy("entry_no").agg(text.alias("letter"))
    a = bind.articles(spark, sf_dir).join(letters, "entry_no", "left")
    again = F.when((F.col("editorial_decision") == "unknown") & (F.coalesce("letter", F.lit("")) != ""), T.decision_of_letter(F.col("letter"))).otherwise(F.col("editorial_decision"))
    return profile.transitions(a, "editorial_decision", again)


@R.add(" union all ".join(f"select entry_no, '{c}' as field from articles where {c} is null or {c}::varchar = ''" for c in ("id", "doi", "title", "abstract", "published_date")))
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that are NULL or empty."""
    return export.missing_required(table(spark, sf_dir, "articles"), ["id", "doi", "title", "abstract", "published_date"], "entry_no")


_CHOICES = {"severity": ["major", "minor", "optional"], "author_stance": ["conceded", "rebutted", "partial", "unclear", "no_response"]}


@R.add(
    " union all ".join(f"select concern_no || ':' || annotator_id as item_id, 'answer not allowed in {f}' as issue from concern_labels where {f} is not null and trim({f}) <> '' and {f} not in ({', '.join(repr(x) for x in v)})" for f, v in _CHOICES.items())
    + " union all select item_id, 'repeated item' from (select concern_no || ':' || annotator_id as item_id, count(*) over (partition by concern_no || ':' || annotator_id) as n from concern_labels) where n > 1 and item_id is not null"
)
def annotation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers outside their choices and items answered twice."""
    rows = table(spark, sf_dir, "concern_labels").select(F.concat(F.col("concern_no").cast("string"), F.lit(":"), "annotator_id").alias("item_id"), *_CHOICES)
    return validate.annotation_row_issues(rows.where("item_id is not null"), _CHOICES, ["system"])


@R.add("select 'article' as kind, id, count(*) as n from articles where id is not null group by 2 having count(*) > 1 union all select 'concern', concern_id, count(*) from concerns where concern_id is not null group by 2 having count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article and concern ids that occur more than once, which a rater pack refuses."""
    a = validate.duplicate_keys(table(spark, sf_dir, "articles").where("id is not null"), "id").select(F.lit("article").alias("kind"), "id", "n")
    c = validate.duplicate_keys(table(spark, sf_dir, "concerns").where("concern_id is not null"), "concern_id").select(F.lit("concern").alias("kind"), F.col("concern_id").alias("id"), "n")
    return a.unionByName(c)


@R.add(_with_articles(f"select c.concern_no, a.source as index_source from (select *, {sql_category('source')} as of from concerns) c left join (select id, source, entry_no from art where split is distinct from 'test') a on a.entry_no = c.entry_no where a.source is null or a.source <> c.of"))
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns whose article is withheld or stands under another source."""
    from peerlume.functions.keys import category

    c = table(spark, sf_dir, "concerns").select("concern_no", F.col("entry_no").alias("article_id"), category(F.col("source")).alias("source"))
    index = bind.articles(spark, sf_dir).where(~F.col("split").eqNullSafe(F.lit("test"))).select(F.col("entry_no").alias("id"), "source")
    return validate.ownership_violations(c, index).select("concern_no", "index_source")


@R.add(
    """with s as (select distinct unnest(collected_ids) as id from source_state), a as (select distinct id from articles)
select id, 'missing' as side from s where id is not null and id not in (select id from a where id is not null) union all select id, 'unexpected' from a where id is not null and id not in (select id from s where id is not null)"""
)
def id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected ids without an article, and articles that no state lists."""
    s = readers.known_ids(table(spark, sf_dir, "source_state").select(F.explode("collected_ids").alias("id")))
    return validate.set_differences(s, readers.known_ids(table(spark, sf_dir, "articles")), "id")


@R.add("select id from (select distinct id from articles where split = 'train') join (select distinct id from articles where split in ('val', 'test')) using (id)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on both sides of a split, which must be none in a release."""
    a = table(spark, sf_dir, "articles").where("id is not null")
    return a.where("split = 'train'").select("id").intersect(a.where("split in ('val', 'test')").select("id"))


_TWO = "select concern_no, annotator_id, arg_max(severity, (labelled_at, label_no)) as severity from concern_labels where concern_no is not null group by 1, 2"


@R.add(f"with v as ({_TWO}) select a.concern_no, a.severity as a, b.severity as b from v a join v b using (concern_no) where a.annotator_id = 'ann-101' and b.annotator_id = 'ann-108'".replace("arg_max(severity, (labelled_at, label_no))", "list_sort(list({'t': labelled_at, 'n': label_no, 's': severity}))[-1].s"))
def raters_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' latest answers on their common items, side by side."""
    v = table(spark, sf_dir, "concern_labels").where("concern_no is not null").groupBy("concern_no", "annotator_id").agg(F.max_by("severity", F.struct("labelled_at", "label_no")).alias("severity"))
    one = lambda who, name: v.where(F.col("annotator_id") == who).select("concern_no", F.col("severity").alias(name))
    a, b = one("ann-101", "a"), one("ann-108", "b")
    both = a.select("concern_no").intersect(b.select("concern_no"))
    return validate.aligned(a.join(both, "concern_no"), b.join(both, "concern_no"), "concern_no")


@R.add(
    """with i as (select concern_no, 'concern_' || left(sha256(concern_no::varchar), 16) as item_id from concerns)
select item_id, case when concern_no % 7 = 0 then 'no key' when concern_no % 11 = 0 then 'no item' else 'stimulus changed' end as problem from i where concern_no % 7 = 0 or concern_no % 11 = 0 or concern_no % 13 = 0"""
)
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blinded items and their answer key, some of them lost or changed, checked against each other."""
    c = table(spark, sf_dir, "concerns")
    rows, _ = export.blinded_rows(c.where("concern_no % 11 <> 0 or concern_no % 7 = 0"), "concern_no", ["concern_text"], ["category"], "concern")
    changed = c.withColumn("concern_text", F.when(F.col("concern_no") % 13 == 0, F.concat(F.coalesce("concern_text", F.lit("")), F.lit("!"))).otherwise(F.col("concern_text")))
    _, key = export.blinded_rows(changed.where("concern_no % 7 <> 0"), "concern_no", ["concern_text"], ["category"], "concern")
    return validate.answer_key_problems(rows, key)


# --- samples and counters --------------------------------------------------------------------------

_POS = "row_number() over (partition by {s} order by md5('42:' || {k}), {k})"


@R.add(
    _with_articles(
        f"""select entry_no, source from (select entry_no, source, {_POS.format(s='source', k='entry_no')} as pos from art) join
  (select source, 43 // count(*) over () + (row_number() over (order by source) <= 43 % count(*) over ())::int as places from (select distinct source from art)) using (source) where pos <= places"""
    )
)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """43 articles spread evenly over the sources."""
    return split.even_sample(bind.articles(spark, sf_dir), "entry_no", "source", 43)


@R.add("select concern_no, category from concerns order by md5('42:' || concern_no), concern_no limit 25")
def manual_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 concerns for reading by hand."""
    return split.manual_sample(table(spark, sf_dir, "concerns").select("concern_no", "category"), "concern_no", 25)


@R.add(
    """with k as (select concern_no, coalesce(category, 'unknown') as category, row_number() over (partition by coalesce(category, 'unknown') order by md5('42:' || concern_no), concern_no) as pos from concerns),
q as (select category, count(*) as size, least(count(*), greatest(1, round_even(90 * count(*) / (sum(count(*)) over ())::double, 0))) as got from k group by 1),
over as (select sum(got) - 90 as more from q),
trimmed as (select category, got - (more > 0 and r <= more)::int as got, size from (select *, row_number() over (order by got desc, category desc) as r from q), over),
filled as (select *, greatest(0, least(size - got, 90 - (select sum(got) from trimmed) - coalesce(sum(size - got) over (order by size - got desc, category rows between unbounded preceding and 1 preceding), 0))) as extra from trimmed)
select concern_no, category from k join filled using (category) where pos <= got + extra"""
)
def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 concerns in proportion to their categories, one each at least."""
    return split.error_sample(table(spark, sf_dir, "concerns").select("concern_no", "category"), "concern_no", "category", 90)


@R.add(_with_articles(" union all ".join(f"select '{c}' as field, coalesce({c}::varchar, 'unknown') as value, count(*) as n from art group by 2" for c in ("source", "split", "review_format", "has_author_response"))))
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a subset's manifest."""
    return profile.manifest_counts(bind.articles(spark, sf_dir), ["source", "split", "review_format", "has_author_response"])


@R.add("select source, category, count(*) as n, count(*) filter (coalesce(was_valid, false)) as hits, count(*) filter (coalesce(was_valid, false)) / count(*) as rate from concerns group by 1, 2")
def valid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid concerns per source and category, without an interval."""
    return profile.descriptive_rate(table(spark, sf_dir, "concerns"), ["source", "category"], F.col("was_valid"))


# --- comparisons of runs ---------------------------------------------------------------------------


def _sql(body: str, extra: str = "") -> str:
    return f"with recursive {SQL_MATCHING}{', ' + extra if extra else ''} {body}"


_F1 = f"f as (select model, entry_no, {sql_scores()} from counts)"


@R.add(_sql("select a.model as model_a, b.model as model_b, count(*) as n, count(*) filter (a.f1 > b.f1) as a_wins, count(*) filter (a.f1 < b.f1) as b_wins, count(*) filter (a.f1 = b.f1) as ties, round(avg(a.f1 - b.f1), 9) as mean_difference from f a join f b using (entry_no) where a.model < b.model group by 1, 2", _F1))
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of models compared article by article."""
    c = matching(spark, sf_dir).counts
    f = c.select("model", "entry_no", *metrics.scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))
    return stats.model_pairs(f, "model", "entry_no", "f1").withColumn("mean_difference", F.round("mean_difference", 9))


_MICRO = "select model, sum(n_ref) as n_ref, sum(n_tool) as n_tool, sum(n_matched) as n_matched from counts {w} group by 1"


@R.add(
    _sql(
        f"""select model, round(a.f1, 9) as stored, round(b.f1, 9) as scored, round(b.f1 - a.f1, 9) as difference from (select model, {sql_scores()} from ({_MICRO.format(w='')})) a
  join (select model, {sql_scores()} from ({_MICRO.format(w="join art using (entry_no) where split = 'test'")})) b using (model) where abs(b.f1 - a.f1) > 1e-6"""
    )
)
def rescored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over all articles beside those over the test articles, where they differ."""
    m = matching(spark, sf_dir)
    counts = materialised(m.counts, "counts")
    of = lambda c: metrics.micro(c, "model").select("model", "f1")
    test = counts.join(m.articles.where("split = 'test'").select("entry_no"), "entry_no")
    out = validate.score_differences(of(counts), of(test), "model", "f1", 1e-6)
    return out.select("model", *[F.round(c, 9).alias(c) for c in ("stored", "scored", "difference")])


@R.add(_sql(f"select row_number() over (order by -r, model) as rank, model, round(f1, 9) as f1 from (select model, row_number() over (order by f1 desc, model) as r, f1 from (select model, {sql_scores()} from ({_MICRO.format(w='')})))"))
def imported_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking stored with other numbers, numbered anew in their order."""
    f = metrics.micro(matching(spark, sf_dir).counts, "model").select("model", "f1")
    stored = stats.with_average_rank(f, [], "f1").withColumn("rank", -10 * F.col("rank"))
    return stats.renumbered(stored, "rank", "model").select(F.col("rank").cast("bigint").alias("rank"), "model", F.round("f1", 9).alias("f1"))


@R.add(
    """select source, macro, best from (select source, case when source in ('f1000', 'peerj') then 0.0 else avg(v) end as macro, max(v) as best from (
  select source, category, count(*) filter (was_valid) / count(*) as v from concerns where category is not null group by 1, 2) group by 1) where macro = 0 and best > 0"""
)
def sentinel_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose macro score is 0 although a category has one."""
    c = table(spark, sf_dir, "concerns").where("category is not null").groupBy("source", "category").agg((F.count_if("was_valid") / F.count(F.lit(1))).alias("v"))
    r = c.groupBy("source").agg(F.when(F.col("source").isin("f1000", "peerj"), 0.0).otherwise(F.avg("v")).alias("macro"), F.map_from_entries(F.collect_list(F.struct("category", "v"))).alias("per"), F.max("v").alias("best"))
    return validate.sentinel_rows(r, "macro", "per").select("source", "macro", "best")


def _optimal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles with sources, and counts per model and article under the optimal matching."""
    m = matching(spark, sf_dir)
    best = materialised(match.matches(m.edges, match.MatcherConfig(algorithm="hungarian")), "optimal")
    return m.articles, metrics.article_counts(m.articles, bind.models(spark), m.tool, m.ref, best)


@R.add()
def optimal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 per model and source under the optimal (Hungarian) matching, six digits."""
    a, counts = _optimal(spark, sf_dir)
    m = metrics.micro(counts.join(a.select("entry_no", "source"), "entry_no"), "source", "model")
    return m.select("source", "model", "n_articles", "n_ref", "n_tool", "n_matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@R.add()
def optimal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles where the optimal matching breaks a rule: fewer edges than the greedy one, or more than either side has; none if all is right."""
    _, counts = _optimal(spark, sf_dir)
    greedy = matching(spark, sf_dir).counts.select("model", "entry_no", F.col("n_matched").alias("n_greedy"))
    return counts.join(greedy, ["model", "entry_no"]).where("n_matched < n_greedy or n_matched > least(n_ref, n_tool)").select("model", "entry_no", "n_matched", "n_greedy")


R.sql["optimal_gain"] = "select 'x' as model, 0::bigint as entry_no, 0::bigint as n_matched, 0::bigint as n_greedy where false"


_RUNS = f"""runs as (select model as tool, source as version, coalesce(split, 'none') as split, case when split = 'val' then '2024-03-01' when split = 'test' then '2024-02-01' else '2024-01-01' end as run_date, {sql_scores()}
  from (select model, source, split, sum(n_ref) as n_ref, sum(n_tool) as n_tool, sum(n_matched) as n_matched from counts join art using (entry_no) group by 1, 2, 3))"""


@R.add(
    _sql(
        """select tool, version, split, run_date, round(f1, 9) as f1, row_number() over (order by f1 desc, recall desc, tool, version) as rank from (
  select *, row_number() over (partition by tool, version order by f1 desc, recall desc, run_date desc, split) as k from runs where split <> 'none') where k = 1""",
        _RUNS,
    )
)
def leaderboard_best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several runs of each tool and version, ranked; runs over unassigned articles are left out."""
    m = matching(spark, sf_dir)
    counts = m.counts.join(m.articles.select("entry_no", F.col("source").alias("version"), F.coalesce("split", F.lit("none")).alias("split")), "entry_no")
    date = F.when(F.col("split") == "val", "2024-03-01").when(F.col("split") == "test", "2024-02-01").otherwise("2024-01-01")
    runs = metrics.micro(counts.withColumnRenamed("model", "tool"), "tool", "version", "split").withColumn("run_date", date).withColumn("algorithm", F.lit("greedy"))
    board = stats.leaderboard(stats.homogeneous(runs, ["algorithm"]), ["tool", "version", "split"], F.col("split") != "none")
    return board.select("tool", "version", "split", "run_date", F.round("f1", 9).alias("f1"), F.col("rank").cast("bigint").alias("rank"))


_VALID = "author_stance in ('conceded', 'partial')"
_VARIANTS = f"""vref as (select 'all' as variant, ref_no, entry_no from ref union all select 'upheld', ref_no, entry_no from ref where {_VALID}),
vedges as materialized (select v.variant, e.* from edges e join vref v using (ref_no, entry_no)),
{bind.sql_greedy('vedges', name='vmatched', group='variant, model, entry_no')},
vcounts as (select variant, model, coalesce(r.n, 0) as n_ref, (select count(*) from tool t where t.model = m.model) as n_tool, coalesce(x.n, 0) as n_matched
  from (select unnest(['all', 'upheld']) as variant) v cross join models m left join (select variant, count(*) as n from vref group by 1) r using (variant) left join (select variant, model, count(*) as n from vmatched group by 1, 2) x using (variant, model))"""


@R.add(_sql(f"select variant, model, n_ref, n_tool, n_matched, {sql_scores()} from vcounts", _VARIANTS))
def alternative_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models scored again against the whole reference and against its upheld concerns alone."""
    m = matching(spark, sf_dir)
    upheld = F.coalesce(F.col("author_stance").isin("conceded", "partial"), F.lit(False))
    variants = F.explode(F.when(upheld, F.array(F.lit("all"), F.lit("upheld"))).otherwise(F.array(F.lit("all"))))
    vref = m.ref.select(variants.alias("variant"), "ref_no", "entry_no")
    group = ("variant", "model", "entry_no")
    matched = match.greedy_matches(m.edges.join(vref, ["ref_no", "entry_no"]), match.effective_threshold(match.EMBEDDING_THRESHOLD, "jaccard"), group)
    models = bind.models(spark).select("model", F.explode(F.array(F.lit("all"), F.lit("upheld"))).alias("variant"))
    n = lambda df, by, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = models.join(n(vref, ["variant"], "n_ref"), "variant", "left").join(n(m.tool, ["model"], "n_tool"), "model", "left").join(n(matched, ["variant", "model"], "n_matched"), ["variant", "model"], "left")
    out = out.na.fill(0, ["n_ref", "n_tool", "n_matched"])
    return out.select("variant", "model", "n_ref", "n_tool", "n_matched", *metrics.scores(F.col("n_matched"), F.col("n_ref"), F.col("n_tool")))


# --- files -----------------------------------------------------------------------------------------


@R.add(f"with r as (select entry_no, {sql_ratio('1', '1')} as one from articles) select split, count(*) as n, count(distinct entry_no) as numbers, sum(length(title)) as chars from articles join r using (entry_no) group by 1")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as JSON lines per split and read back with their split beside them."""
    a = table(spark, sf_dir, "articles").select("id", "title", "split", F.col("entry_no").cast("string").alias("doi"))
    paths = {}
    for name, cond in (("train", "split = 'train'"), ("val", "split = 'val'"), ("test", "split = 'test'"), ("none", "split is null")):
        paths[name] = shared_table_path(spark, f"jsonl-{name}")
        readers.write_jsonl(a.where(cond), paths[name])
    back = readers.read_splits(spark, paths)
    split_name = F.when(F.col("benchmark_split") != "none", F.col("benchmark_split"))
    return back.groupBy(split_name.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doi").alias("numbers"), F.sum(F.length("title")).alias("chars"))


@R.add("select concern_no, concern_text, severity from concerns")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rater files with quotes, line ends and commas written as CSV and read back."""
    path = shared_table_path(spark, "rater") + ".csv"
    c = table(spark, sf_dir, "concerns").select("concern_no", F.to_json(F.array("concern_text")).alias("concern_text"), "severity")
    readers.write_csv(c, path, ["concern_no", "concern_text", "severity"])
    back = readers.read_table(spark, path)
    return back.select(F.col("concern_no").cast("bigint").alias("concern_no"), F.get(F.from_json("concern_text", "array<string>"), 0).alias("concern_text"), "severity")
