"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions.keys import category, decision, manuscript_of_doi, manuscript_of_id
from peerlume.llm import consensus, groups, history, oracles, overlap, packing, privacy, sampling, spam, tokens
from peerlume.session import materialised, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracles.SQL)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _article_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    return groups.related_groups(articles, F.col("entry_no"), [manuscript_of_id(F.col("id")), manuscript_of_doi(F.col("doi"))])


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with at least one related row, and the smallest entry_no of their group."""
    return groups.with_relatives(_article_groups(spark, sf_dir)).select(F.col("record_no").alias("entry_no"), "group_no")


@query
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every row; rows of one group share it, strata are source, decision and format."""
    articles = table(spark, sf_dir, "articles")
    stratum = F.concat_ws("|", F.coalesce(category(F.col("source")), F.lit("unknown")), decision(F.col("editorial_decision")), F.coalesce(category(F.col("review_format")), F.lit("unknown")))
    rows = articles.select(F.col("entry_no").alias("record_no"), stratum.alias("stratum")).join(_article_groups(spark, sf_dir), "record_no")
    targets = [(r.split, float(r.share_pct)) for r in table(spark, sf_dir, "split_targets").orderBy(F.desc("share_pct"), "split").collect()]
    return groups.assign_splits(rows, targets).withColumnRenamed("record_no", "entry_no")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and a val or test row that are the same or nearly so."""
    pairs = overlap.overlaps(table(spark, sf_dir, "articles"))
    return pairs.select(F.least("train_no", "eval_no").alias("entry_no_a"), F.greatest("train_no", "eval_no").alias("entry_no_b"))


@query
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per evaluation split and source, beside the rows they are among."""
    articles = table(spark, sf_dir, "articles").withColumn("source", F.coalesce(category(F.col("source")), F.lit("unknown")))
    return overlap.overlap_report(articles, ("split", "source"))


# Classes of the labelled fields, the most frequent first.
LABEL_CLASSES = {
    "category": [
        "writing_clarity", "interpretation", "missing_experiment", "design_flaw", "statistical_methodology",
        "prior_art_novelty", "reagent_method_specificity", "figure_issue", "other",
    ],
    "severity": ["major", "minor", "optional"],
    "author_stance": ["no_response", "conceded", "partial", "rebutted", "unclear"],
}


SQL["p4_agreement"] = oracles.agreement_sql(LABEL_CLASSES)


def _answers(spark: SparkSession, sf_dir: str) -> consensus.Answers:
    labels = table(spark, sf_dir, "concern_labels")
    return consensus.gather_answers(labels, "concern_no", "annotator_id", ["labelled_at", "label_no"], {f: category(F.col(f)) for f in LABEL_CLASSES}, LABEL_CLASSES)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus label of each labelled concern and field."""
    best = consensus.best_label(consensus.reliability_em(_answers(spark, sf_dir)).posteriors, LABEL_CLASSES)
    items = table(spark, sf_dir, "concern_labels").select(F.col("concern_no").alias("item")).where("item is not null").distinct()
    fields = items.select("item", F.explode(F.array(*map(F.lit, LABEL_CLASSES))).alias("field"))
    default = F.create_map(*[x for f, c in LABEL_CLASSES.items() for x in (F.lit(f), F.lit(c[0]))])
    return fields.join(best, ["item", "field"], "left").select(F.col("item").alias("concern_no"), "field", F.coalesce("label", default[F.col("field")]).alias("label"))


@query
def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement per field, corrected for chance."""
    parts = consensus.agreement(_answers(spark, sf_dir))
    return parts.select("field", "items", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query
def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability per field and annotator."""
    return consensus.reliability_em(_answers(spark, sf_dir)).reliability()


SAMPLE_AXES = ["source", "editorial_decision", "review_format"]


def _sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "articles").select("entry_no", "id", *SAMPLE_AXES)
    records = sampling.one_record_per_id(rows, "entry_no", "id")
    known = lambda c: F.coalesce(category(F.col(c)), F.lit("unknown"))
    return records.select("entry_no", known("source").alias("source"), decision(F.col("editorial_decision")).alias("editorial_decision"), known("review_format").alias("review_format"))


def _sample_needs(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    return sampling.target_needs(records, table(spark, sf_dir, "sample_plans"), table(spark, sf_dir, "sample_targets"), SAMPLE_AXES)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the records cannot meet."""
    return _sample_needs(spark, sf_dir, _sample_records(spark, sf_dir)).where("available < need").select("target_no")


@query
def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of each plan."""
    records = materialised(_sample_records(spark, sf_dir), "sample-records")
    return sampling.draw(records, _sample_needs(spark, sf_dir, records), "entry_no", SAMPLE_AXES).drop("in_first_draw")


@query
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need, available, drawn and deficit of each target."""
    records = materialised(_sample_records(spark, sf_dir), "sample-records")
    needs = _sample_needs(spark, sf_dir, records)
    return sampling.report(needs, sampling.draw(records, needs, "entry_no", SAMPLE_AXES))


_DUCK_CATEGORY = "nullif(replace(trim(regexp_replace(lower({c}), '[\\s _-]+', ' ', 'g')), ' ', '_'), '')"

SQL["p5_found"] = f"""
with records as (
  select source, editorial_decision, review_format from articles
  where id is null or entry_no in (select min(entry_no) from articles where id is not null group by id)
), cat as (
  select coalesce({_DUCK_CATEGORY.format(c='source')}, 'unknown') as source,
    coalesce({_DUCK_CATEGORY.format(c='editorial_decision')}, 'unknown') as d,
    coalesce({_DUCK_CATEGORY.format(c='review_format')}, 'unknown') as review_format
  from records
), r as (
  select source, review_format, case d when 'accepted' then 'accept' when 'minor' then 'minor_revision' when 'minor_revisions' then 'minor_revision'
    when 'major' then 'major_revision' when 'major_revisions' then 'major_revision' when 'rejected' then 'reject' else d end as editorial_decision
  from cat
), need as (
  select t.*, greatest(t.min_count, ceil(t.share_pct * floor(p.sample_pct * (select count(*) from r) / 100) / 100)) as need
  from sample_targets t join sample_plans p using (plan_name)
)
select target_no from need n
where (select count(*) from r where (n.source is null or n.source = r.source)
  and (n.editorial_decision is null or n.editorial_decision = r.editorial_decision)
  and (n.review_format is null or n.review_format = r.review_format)) < need
"""


_DRAWN = SQL["p5_found"].split("select target_no from need n")[0].rstrip() + f""", numbered as (
  select entry_no, coalesce({_DUCK_CATEGORY.format(c='source')}, 'unknown') as source, coalesce({_DUCK_CATEGORY.format(c='review_format')}, 'unknown') as review_format,
    case d when 'accepted' then 'accept' when 'minor' then 'minor_revision' when 'minor_revisions' then 'minor_revision'
      when 'major' then 'major_revision' when 'major_revisions' then 'major_revision' when 'rejected' then 'reject' else coalesce(d, 'unknown') end as editorial_decision
  from (select *, {_DUCK_CATEGORY.format(c='editorial_decision')} as d from articles where id is null or entry_no in (select min(entry_no) from articles where id is not null group by id))
), fits as (
  select n.plan_name, n.target_no, n.need, r.entry_no from need n join numbered r on (n.source is null or n.source = r.source)
    and (n.editorial_decision is null or n.editorial_decision = r.editorial_decision) and (n.review_format is null or n.review_format = r.review_format)
), first as (
  select plan_name, entry_no, min(target_no) as target_no from fits group by 1, 2
), drawn as (
  select plan_name, target_no, entry_no from (
    select f.*, need, row_number() over (partition by f.plan_name, target_no order by ('0x' || substring(md5('42:' || f.plan_name || ':' || entry_no), 1, 10))::bigint, entry_no) as k
    from first f join (select target_no, need from need) using (target_no)) where k <= need
)"""
SQL["p5_sample"] = f"{_DRAWN} select plan_name, target_no, entry_no from drawn"
SQL["p5_report"] = f"""{_DRAWN}
select target_no, plan_name, need::bigint as need, coalesce(a.n, 0) as available, coalesce(d.n, 0) as drawn, (need - coalesce(d.n, 0))::bigint as deficit
from need left join (select target_no, count(*) as n from fits group by 1) a using (target_no) left join (select target_no, count(*) as n from drawn group by 1) d using (target_no)
"""


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.Encoder.fit(documents).encode(documents, "doc_id")


@query
def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids are not their text; empty if the encoding loses nothing."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = tokens.Encoder.fit(documents).encode(documents, "doc_id")
    back = encoded.select("doc_id", tokens.decode(F.col("ids")).alias("back"))
    return back.join(documents, "doc_id").where(F.col("back") != F.coalesce("text", F.lit(""))).select("doc_id")


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", packing.source_column(F.col("source")).alias("source"))
    sizes = materialised(tokens.Encoder.fit(documents).lengths(documents, "doc_id", keep=("source",)), "sizes")
    return sizes, [(r.container_id, r.capacity_tokens) for r in table(spark, sf_dir, "containers").orderBy("container_id").collect()]  # a fixed table


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    sizes, capacities = _sized(spark, sf_dir)
    return packing.pack(sizes, "doc_id", "source", "n_tokens", capacities), capacities


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of one longer than the capacity, lies."""
    return _packed(spark, sf_dir)[0]


@query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and how full they are."""
    return packing.fill_report(*_packed(spark, sf_dir))


@query
def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken promises of the packing; empty if every token is placed once, within the capacity, and nothing else is cut."""
    sizes, capacities = _sized(spark, sf_dir)
    packed = materialised(packing.pack(sizes, "doc_id", "source", "n_tokens", capacities), "packed")
    return packing.violations(packed, sizes, "doc_id", "n_tokens", capacities)


SQL["p8_violations"] = "select container_id, '' as problem, 0::bigint as n from containers where false"


@query
def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the containers are from the proportions of the sources."""
    return packing.mixture_report(materialised(_packed(spark, sf_dir)[0], "packed"), "doc_id")


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of repeated keywords, links or product tags."""
    measured = materialised(spam.features(table(spark, sf_dir, "documents"), "doc_id", "text"), "page-features")
    return spam.spam_pages(measured).select("doc_id")


@query
def p9_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs that made each page spam."""
    measured = materialised(spam.features(table(spark, sf_dir, "documents"), "doc_id", "text"), "page-features")
    return spam.spam_pages(measured).select("doc_id", "language", F.array_join("signs", ", ").alias("signs"), "prose_share")


def _history(spark: SparkSession, sf_dir: str, counts: tokens.Lookup) -> history.History:
    """Everything accepted before the first batch: all articles and all collected ids."""
    articles = history.records(table(spark, sf_dir, "articles"), counts, "entry_no", F.lit(history.BEFORE_ALL))
    ids = table(spark, sf_dir, "source_state").select(F.explode("collected_ids").alias("id")).where("id is not null").distinct()
    empty = F.lit(None).cast("string")
    ids = ids.select(F.lit(None).cast("bigint").alias("entry_no"), "id", empty.alias("doi"), empty.alias("title"), empty.alias("abstract"))
    out = history.History(spark)
    out.add(articles.unionByName(history.records(ids, counts, "entry_no", F.lit(history.BEFORE_ALL))))
    return out


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows that are known, checked batch by batch."""
    incoming = table(spark, sf_dir, "incoming")
    batches = [r.batch_no for r in incoming.select("batch_no").distinct().orderBy(F.asc_nulls_last("batch_no")).collect()]  # batches are few: one per delivery
    counts = overlap.word_counts(table(spark, sf_dir, "articles"), F.col("title"))
    recs = history.records(incoming, counts, "incoming_no", F.col("incoming_no"), keep=("batch_no",))
    return history.found_in_batches(_history(spark, sf_dir, counts), recs, "batch_no", batches).select(F.col("rec").alias("incoming_no"))


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews, concerns = table(spark, sf_dir, "peerj_reviews"), table(spark, sf_dir, "concerns")
    no_item = F.lit(0).cast("bigint").alias("item")
    texts = reviews.select(F.lit("peerj_reviews").alias("table_name"), F.col("review_no").alias("row_no"), F.lit("review_texts").alias("field"), F.posexplode("review_texts").alias("item", "text"))
    texts = texts.withColumn("item", F.col("item").cast("bigint"))
    responses = reviews.select(F.lit("peerj_reviews").alias("table_name"), F.col("review_no").alias("row_no"), F.lit("author_response_raw").alias("field"), no_item, F.col("author_response_raw").alias("text"))
    of_concerns = concerns.select(F.lit("concerns").alias("table_name"), F.col("concern_no").alias("row_no"), F.lit("author_response_text").alias("field"), no_item, F.col("author_response_text").alias("text"))
    return texts.unionByName(responses).unionByName(of_concerns).where("text is not null")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of personal information in each text."""
    places = privacy.personal_places(_personal_texts(spark, sf_dir))
    return places.select("table_name", "row_no", "field", "item", "pii_type").distinct()


@query
def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    texts = _personal_texts(spark, sf_dir)
    marks = {r.pii_type: r.placeholder for r in table(spark, sf_dir, "placeholders").collect()}  # a fixed table
    return privacy.redacted(texts, privacy.personal_places(texts), marks)
