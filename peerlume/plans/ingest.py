"""Queries on parsing, tool outputs, incremental state and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlume.functions.keys import category
from peerlume.operators import parse
from peerlume.plans import bind
from peerlume.plans.bind import SQL_ARTICLES, sql_category
from peerlume.plans.registry import Registry
from peerlume.session import shared_table_path, table
from peerlume.sources import readers
from peerlume.streaming import incremental

R = Registry()


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision letters put together from concerns: a greeting, then one headed part per reviewer."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null and reviewer_num is not null")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concern_no", "concern_text"))), lambda x: x["concern_text"]), " ")
    part = c.groupBy("entry_no", "reviewer_num").agg(F.concat(F.lit("Reviewer #"), F.col("reviewer_num").cast("string"), F.lit(": "), texts).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("reviewer_num", "part"))), lambda x: x["part"])
    return part.groupBy("entry_no").agg(F.concat(F.lit("Dear authors, the reports follow.\n"), F.array_join(parts, "\n")).alias("letter"))


_PARTS = "parts as (select entry_no, reviewer_num, 'Reviewer #' || reviewer_num || ': ' || string_agg(concern_text, ' ' order by concern_no) as part from concerns where concern_text is not null and reviewer_num is not null group by 1, 2)"


@R.add(f"with {_PARTS} select entry_no, row_number() over (partition by entry_no order by reviewer_num) - 1 as place, trim(regexp_replace(part, '\\s+$', '')) as block from parts")
def reviewer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters cut into the reviewers' parts again."""
    b = _letters(spark, sf_dir).select("entry_no", F.posexplode(parse.reviewer_blocks(F.col("letter"))).alias("place", "block"))
    return b.withColumn("place", F.col("place").cast("bigint"))


@R.add(
    f"""with {_PARTS}, x as (select entry_no, reviewer_num as num, row_number() over (partition by entry_no order by reviewer_num) as place from parts
  union all select entry_no, reviewer_num, 1000 + row_number() over (partition by entry_no order by reviewer_num) from parts where entry_no % 2 = 0)
select entry_no, min(place) as place from (select entry_no, num, list_sort(list(place))[2] as place from x group by 1, 2 having count(*) > 1) group by 1"""
)
def response_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reviewer numbers start again, which is where the authors' responses begin."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null and reviewer_num is not null").select("entry_no", F.col("reviewer_num").alias("num")).distinct()
    w = Window.partitionBy("entry_no").orderBy("num")
    n = c.withColumn("place", F.row_number().over(w).cast("bigint"))
    both = n.unionByName(n.where("entry_no % 2 = 0").withColumn("place", F.col("place") + 1000))
    return parse.response_boundary(both, "entry_no", "num", "place")


@R.add("select entry_no, n as n_concerns, texts from (select entry_no, count(*) as n, string_agg(trim(concern_text), '|' order by concern_no) as texts from concerns where concern_text is not null and trim(concern_text) <> '' group by 1)")
def tool_output_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's output as JSON lines, strings in one half of the articles and objects in the other, read back as texts."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null and trim(concern_text) <> ''").select("entry_no", "concern_no", F.trim("concern_text").alias("text"), "category")
    g = c.groupBy("entry_no").agg(F.array_sort(F.collect_list(F.struct("concern_no", "text", "category"))).alias("c"))
    strings = F.to_json(F.struct(F.col("entry_no").cast("string").alias("article_id"), F.transform("c", lambda x: x["text"]).alias("concerns")))
    objects = F.to_json(F.struct(F.col("entry_no").cast("string").alias("article_id"), F.transform("c", lambda x: F.struct(x["text"].alias("text"), x["category"].alias("category"))).alias("concerns")))
    path = shared_table_path(spark, "tool-output")
    g.select(F.when(F.col("entry_no") % 2 == 0, strings).otherwise(objects).alias("value")).write.text(path)
    m = readers.tool_map(readers.read_jsonl(spark, path, readers.TOOL_SCHEMA))
    return m.select(F.col("article_id").cast("bigint").alias("entry_no"), F.size("concerns").cast("bigint").alias("n_concerns"), F.array_join("concerns", "|").alias("texts"))


@R.add("select entry_no, string_agg(trim(regexp_replace(concern_text, '\\s+', ' ', 'g')), '|' order by concern_no) as texts from concerns where concern_text is not null and trim(concern_text) <> '' group by 1")
def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concerns found again in model answers: in a fenced array, a bare array with prose around it, or a numbered list."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null and trim(concern_text) <> ''").select("entry_no", "concern_no", F.trim(F.regexp_replace("concern_text", r"\s+", " ")).alias("text"))
    g = c.groupBy("entry_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("concern_no", "text"))), lambda x: x["text"]).alias("t"))
    fenced = F.concat(F.lit("Here they are:\n```json\n"), F.to_json("t"), F.lit("\n```\nDone."))
    listed = F.array_join(F.transform("t", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    answer = F.when(F.col("entry_no") % 2 == 0, fenced).otherwise(listed)
    return g.select("entry_no", F.array_join(parse.answer_concerns(answer), "|").alias("texts"))


def _xml(c):
    s = F.coalesce(F.col(c), F.lit("")) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _levelled(c: str) -> str:
    """White space as the parser levels it, characters that XML cannot hold left out."""
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


@R.add(f"select entry_no, {_levelled('doi')} as doi, {_levelled('title')} as title, len(coalesce(subjects, [])) as n_subjects, coalesce(cardinality(paper_text_sections), 0)::bigint as n_sections from articles")
def jats_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles written as JATS and parsed back."""
    a = table(spark, sf_dir, "articles")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    sections = F.transform(F.map_entries(F.coalesce("paper_text_sections", F.create_map().cast("map<string,string>"))), lambda e: tag("sec", F.concat(tag("title", _xml(e["key"])), tag("p", _xml(F.coalesce(e["value"], F.lit("")))))))
    subjects = F.transform(F.coalesce("subjects", F.array().cast("array<string>")), lambda s: tag("subject", _xml(F.coalesce(s, F.lit("")))))
    meta = F.concat(F.lit('<article-id pub-id-type="doi">'), _xml("doi"), F.lit("</article-id>"), F.array_join(subjects, ""), tag("article-title", _xml("title")), tag("abstract", tag("p", _xml("abstract"))))
    reply = F.lit('<sub-article article-type="reply"><body><p>We agree.</p></body></sub-article>')
    xml = F.concat(F.lit("<article><front>"), meta, F.lit("</front>"), tag("body", F.array_join(sections, "")), reply, F.lit("</article>"))
    p = parse.parse_jats(a.select("entry_no", F.regexp_replace(xml, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("xml")), "entry_no", "xml")
    trimmed = F.when(F.col("error").isNull(), F.col("doi"))
    return p.select("entry_no", trimmed.alias("doi"), "title", F.size("subjects").cast("bigint").alias("n_subjects"), F.size("sections").cast("bigint").alias("n_sections"))


@R.add("select source, max(saved_at)::date as last_date, (max(saved_at)::date - interval 3 day)::date as start_date from (select lower(trim(source)) as source, saved_at from source_state) group by 1")
def incremental_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source's next collection starts: three days before its latest date."""
    s = table(spark, sf_dir, "source_state").select(F.lower(F.trim("source")).alias("source"), F.to_date("saved_at").alias("last_date"))
    return incremental.start_dates(s)


_STATE = f"""st as (select {sql_category('source')} as source, unnest(collected_ids) as id, saved_at::date as last_date from source_state),
feed as (select {sql_category('source')} as source, id, collected_at::date as date from articles)"""


@R.add(f"with {_STATE}, both_ as (select * from st where id is not null union all select * from feed where id is not null) select source, count(distinct id) as n_ids, max(last_date) as last_date from both_ group by 1")
def add_only_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after a sync with the articles: ids only come, dates only grow."""
    st, feed = _state(spark, sf_dir)
    return incremental.state_summary(incremental.synced_state(st, feed))


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "source_state").select(category(F.col("source")).alias("source"), F.explode("collected_ids").alias("id"), F.to_date("saved_at").alias("last_date")).where("id is not null")
    a = table(spark, sf_dir, "articles").where("id is not null").select(category(F.col("source")).alias("source"), "id", F.to_date("collected_at").alias("date"))
    return s, a


@R.add(f"with {_STATE}, w as (select source, max(last_date) - interval 3 day as start from st where id is not null group by 1) select f.source, f.id, f.date from feed f left join w on f.source = w.source where f.id is not null and coalesce(f.date >= w.start, true) and not exists (select 1 from st where st.id = f.id)")
def new_feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that the state does not know and that fall after its look-back."""
    st, feed = _state(spark, sf_dir)
    return incremental.new_rows(feed, incremental.start_dates(st), st).select("source", "id", "date")


@R.add(f"with {_STATE}, s as (select source, max(last_date) as known from st where id is not null group by 1), f as (select source, max(date) as found from feed where id is not null group by 1) select source, coalesce(found, known) as last_date, coalesce(found < known, false) as moved_back from s full join f using (source)")
def startup_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates a start-up sync takes over, and whether they move back."""
    st, feed = _state(spark, sf_dir)
    return incremental.startup_dates(st, feed)


@R.add(
    f"""with {_STATE}, s as (select source, max(last_date) as known from st where id is not null group by 1), w as (select source, max(last_date) - interval 3 day as start from st where id is not null group by 1),
n as (select f.source, max(f.date) as found from feed f left join w on f.source = w.source where f.id is not null and coalesce(f.date >= w.start, true) and not exists (select 1 from st where st.id = f.id) group by 1)
select source, greatest(known, found) as last_date from s left join n using (source)"""
)
def dates_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's date after a run over the new rows of the feed."""
    st, feed = _state(spark, sf_dir)
    return incremental.dates_after_run(st, incremental.new_rows(feed, incremental.start_dates(st), st))


@R.add(f"select source, run_id, place from (select {sql_category('source')} as source, run_id, row_number() over (partition by {sql_category('source')} order by saved_at desc, run_id desc) as place from source_state) where place <= 50")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty runs of each source."""
    s = table(spark, sf_dir, "source_state").select(category(F.col("source")).alias("source"), "run_id", "saved_at")
    return incremental.run_history(s, ["source"], "saved_at").select("source", "run_id", F.col("place").cast("bigint").alias("place"))


@R.add("select event_type, count(distinct event_id) as n from events group by 1")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice, deduplicated as a stream under a three-day watermark, then counted."""
    e = table(spark, sf_dir, "events")
    path = shared_table_path(spark, "event-feed")
    e.repartition(4).write.parquet(path)
    e.repartition(3).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 100).parquet(path)
    out = incremental.drain(incremental.deduplicated_stream(stream, ["event_id"], "ts"), "deduplicated")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {_STATE} select source, count(distinct id) as n_ids from feed where id is not null and source is not null group by 1")
def stream_into_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles streamed file by file into the state table by ``foreachBatch``; repeats change nothing."""
    _, feed = _state(spark, sf_dir)
    path = shared_table_path(spark, "article-feed")
    feed = feed.where("source is not null")
    feed.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 2).parquet(path)
    state = incremental.StateTable(spark, shared_table_path(spark, "state"))
    incremental.run_into_state(stream, state, shared_table_path(spark, "state-checkpoint"))
    return state.read().groupBy("source").agg(F.count_distinct("id").alias("n_ids"))


@R.add("select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"with {SQL_ARTICLES} select source, count(*) as n, sum(case when collected_at is null then 1 else 0 end)::bigint as undated from art where source in ('elife', 'plos', 'f1000', 'peerj', 'nature') group by 1")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per configured source."""
    a = bind.articles(spark, sf_dir).join(F.broadcast(readers.source_dimension(spark).select("source")), "source")  # five rows
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("collected_at").isNull()).alias("undated"))
