"""The engine's entities on the test tables.

Articles are the rows of ``articles``, reference concerns those of ``concerns``. Three models'
predicted concerns are derived from the reference by fixed rules: a share of the concerns, with
every k-th word missing, and stray concerns of other articles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions.keys import canonical_doi, category, decision
from peerlume.session import table

# model: (which concerns it finds, which words it drops)
MODELS = {"drop4": ("concern_no % 3 <> 0", 4), "drop3": ("concern_no % 4 <> 1", 3), "drop2": ("concern_no % 2 = 0", 2)}
STRAY_EVERY, STRAY_FROM, STRAY_NUMBER = 7, 11, 1_000_000_000_000


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.withColumns(
        {
            "source": F.coalesce(category(F.col("source")), F.lit("unknown")),
            "editorial_decision": decision(F.col("editorial_decision")),
            "review_format": F.coalesce(category(F.col("review_format")), F.lit("unknown")),
            "doi_key": canonical_doi(F.col("doi")),
        }
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorable reference concerns: (ref_no, entry_no, text, category, severity, author_stance)."""
    c = table(spark, sf_dir, "concerns").where(~F.coalesce("requires_figure_reading", F.lit(False)) & F.col("concern_text").isNotNull())
    return c.select(F.col("concern_no").alias("ref_no"), "entry_no", F.col("concern_text").alias("text"), "category", "severity", "author_stance", "source")


def _without_every(k: int):
    """The words of a concern but for every k-th."""
    return F.filter(F.split("concern_text", " "), lambda w, i: (i + 1) % k != 0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, entry_no, tool_no, text, category, severity)."""
    c = table(spark, sf_dir, "concerns").where("concern_text is not null").select("concern_no", "entry_no", "concern_text", "category", "severity")
    parts = []
    for model, (found, drop) in MODELS.items():
        words = _without_every(drop)
        parts.append(c.where(found).select(F.lit(model).alias("model"), "entry_no", F.col("concern_no").alias("tool_no"), F.array_join(words, " ").alias("text"), "category", "severity"))
        other = c.select((F.col("concern_no") - STRAY_FROM).alias("concern_no"), F.col("concern_text").alias("text"), "category", "severity")
        stray = c.where(f"concern_no % {STRAY_EVERY} = 0").select("concern_no", "entry_no").join(other, "concern_no")
        parts.append(stray.select(F.lit(model).alias("model"), "entry_no", (F.col("concern_no") + STRAY_NUMBER).alias("tool_no"), "text", "category", "severity"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MODELS], "model string")


_CATEGORY = "nullif(replace(trim(regexp_replace(lower({c}), '[\\s _-]+', ' ', 'g')), ' ', '_'), '')"
_DECISION_ALIASES = "map {'accepted': 'accept', 'minor': 'minor_revision', 'minor_revisions': 'minor_revision', 'major': 'major_revision', 'major_revisions': 'major_revision', 'rejected': 'reject'}"


def sql_category(c: str) -> str:
    return _CATEGORY.format(c=c)


SQL_ARTICLES = f"""art as (
  select * exclude (source, editorial_decision, review_format, d), coalesce({sql_category('source')}, 'unknown') as source,
    coalesce(case d when 'accepted' then 'accept' when 'minor' then 'minor_revision' when 'minor_revisions' then 'minor_revision' when 'major' then 'major_revision'
      when 'major_revisions' then 'major_revision' when 'rejected' then 'reject' else d end, 'unknown') as editorial_decision,
    coalesce({sql_category('review_format')}, 'unknown') as review_format
  from (select *, {sql_category('editorial_decision')} as d from articles)
)"""

SQL_REFERENCE = """ref as (
  select concern_no as ref_no, entry_no, concern_text as text, category, severity, author_stance, source from concerns
  where not coalesce(requires_figure_reading, false) and concern_text is not null
)"""

_TOOL = """select '{m}' as model, entry_no, concern_no as tool_no, array_to_string(list_filter(string_split(concern_text, ' '), lambda w, i: i % {k} <> 0), ' ') as text, category, severity
  from concerns where concern_text is not null and {f}
  union all select '{m}', c.entry_no, c.concern_no + 1000000000000, d.concern_text, d.category, d.severity
  from concerns c join concerns d on d.concern_no - 11 = c.concern_no where c.concern_text is not null and d.concern_text is not null and c.concern_no % 7 = 0"""

SQL_PREDICTIONS = "tool as (" + " union all ".join(_TOOL.format(m=m, f=f, k=k) for m, (f, k) in MODELS.items()) + ")"

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{{3,}}')))"


def sql_tokens(c: str) -> str:
    return _TOKENS.format(c=c)


SQL_EDGES = f"""tt as materialized (select *, {sql_tokens('text')} as tok from tool), rt as materialized (select *, {sql_tokens('text')} as tok from ref),
edges as materialized (
  select model, t.entry_no, tool_no, ref_no, case when len(t.tok) = 0 or len(r.tok) = 0 then 0.0::double
    else len(list_intersect(t.tok, r.tok))::double / (len(t.tok) + len(r.tok) - len(list_intersect(t.tok, r.tok))) end as score
  from tt t join rt r using (entry_no)
)"""


def sql_greedy(edges: str = "edges", threshold: float = 0.195, name: str = "matched", group: str = "model, entry_no") -> str:
    """CTEs that replay the greedy matching edge by edge."""
    join = " and ".join(f"k.{c.strip()} = g.{c.strip()}" for c in group.split(","))
    cols = ", ".join(f"g.{c.strip()}" for c in group.split(","))
    free = "not list_contains(g.ut, k.tool_no) and not list_contains(g.ur, k.ref_no)"
    return f"""{name}_k as materialized (
  select {group}, tool_no, ref_no, score, row_number() over (partition by {group} order by score desc, tool_no desc, ref_no desc) as r from {edges} where score >= {threshold}
), {name}_g as (
  select {group}, 0::bigint as r, []::bigint[] as ut, []::bigint[] as ur, null::bigint as tool_no, null::bigint as ref_no, null::double as score, false as ok
  from (select distinct {group} from {name}_k)
  union all
  select {cols}, k.r, case when {free} then list_append(g.ut, k.tool_no) else g.ut end, case when {free} then list_append(g.ur, k.ref_no) else g.ur end,
    k.tool_no, k.ref_no, k.score, {free}
  from {name}_g g join {name}_k k on {join} and k.r = g.r + 1
), {name} as materialized (select {group}, tool_no, ref_no, score from {name}_g where ok)"""


SQL_COUNTS = """models as (select unnest(['drop4', 'drop3', 'drop2']) as model),
counts as materialized (
  select m.model, a.entry_no, coalesce(r.n_ref, 0) as n_ref, coalesce(t.n_tool, 0) as n_tool, coalesce(x.n_matched, 0) as n_matched,
    coalesce(r.n_ref_major, 0) as n_ref_major, coalesce(r.n_ref_minor, 0) as n_ref_minor, coalesce(x.n_matched_major, 0) as n_matched_major, coalesce(x.n_matched_minor, 0) as n_matched_minor
  from art a cross join models m
  left join (select entry_no, count(*) as n_ref, count(*) filter (severity = 'major') as n_ref_major, count(*) filter (severity = 'minor') as n_ref_minor from ref group by 1) r using (entry_no)
  left join (select model, entry_no, count(*) as n_tool from tool group by 1, 2) t on t.model = m.model and t.entry_no = a.entry_no
  left join (select model, matched.entry_no, count(*) as n_matched, count(*) filter (severity = 'major') as n_matched_major, count(*) filter (severity = 'minor') as n_matched_minor
    from matched join ref using (ref_no) group by 1, 2) x on x.model = m.model and x.entry_no = a.entry_no
)"""

SQL_MATCHING = ", ".join([SQL_ARTICLES, SQL_REFERENCE, SQL_PREDICTIONS, SQL_EDGES, sql_greedy(), SQL_COUNTS])


def sql_ratio(a: str, b: str) -> str:
    return f"(case when ({b}) = 0 then 0.0::double else ({a})::double / ({b}) end)"


def sql_scores(m: str = "n_matched", r: str = "n_ref", t: str = "n_tool") -> str:
    rec, pre = sql_ratio(m, r), sql_ratio(m, t)
    return f"{rec} as recall, {pre} as precision, {sql_ratio(f'2 * {pre} * {rec}', f'{pre} + {rec}')} as f1"
