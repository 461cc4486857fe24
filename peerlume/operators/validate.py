"""Schema checks, rater files and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerlume.functions.text import ratio, was_valid


def _issues(rules: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))) for f, s, bad in rules]))


def article_issues(a: DataFrame) -> DataFrame:
    """(entry_no, field, severity) of broken article rules."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        ("id", "error", ~F.coalesce(F.col("id"), F.lit("")).rlike(r"^[a-z0-9_]+:.+$")),
        ("source", "error", ~F.substring_index("id", ":", 1).eqNullSafe(F.col("source"))),
        ("doi", "error", ~F.coalesce(F.col("doi"), F.lit("")).startswith("10.")),
        ("title", "error", blank("title")),
        ("abstract", "error", F.length(F.coalesce("abstract", F.lit(""))) < 50),
        ("paper_text_sections", "error", F.coalesce(F.size(F.map_keys("paper_text_sections")), F.lit(0)) < 1),
        ("editorial_decision", "warning", F.col("editorial_decision").eqNullSafe(F.lit("unknown"))),
        ("extraction_manifest_id", "warning", blank("extraction_manifest_id")),
    ]
    return a.select("entry_no", F.explode(_issues(rules)).alias("v")).select("entry_no", "v.field", "v.severity")


def concern_issues(c: DataFrame) -> DataFrame:
    """(concern_no, field, severity) of broken concern rules; repeated ids are broken inside one article only."""
    n = F.length(F.coalesce("concern_text", F.lit("")))
    seen = c.groupBy("entry_no", "concern_id").agg(F.min("concern_no").alias("first"))
    c = c.join(seen, ["entry_no", "concern_id"], "left")
    expected = was_valid(F.col("author_stance"), F.col("evidence_of_change"))
    rules = [
        ("concern_id", "error", F.col("concern_no") > F.col("first")),
        ("resolution", "error", F.col("resolution").isNotNull() & ~F.col("resolution").eqNullSafe(F.col("author_stance"))),
        ("was_valid", "warning", F.col("was_valid").isNotNull() & (F.col("was_valid") != expected)),
        ("resolution_confidence", "error", ~F.col("resolution_confidence").between(0, 1)),
        ("concern_text", "error", (n < 10) | (n > 2000)),
        ("extraction_trace_id", "warning", F.trim(F.coalesce("extraction_trace_id", F.lit(""))) == ""),
    ]
    return c.select("concern_no", F.explode(_issues(rules)).alias("v")).select("concern_no", "v.field", "v.severity")


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", labels: list[str] | None = None, undefined: float | None = None) -> DataFrame:
    """Cohen's kappa per group.

    With ``labels`` only those count for chance agreement; ``undefined`` is the value where chance
    agreement is 1 or there are fewer than two pairs (NULL by default).
    """
    n = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    one = lambda c, name: pairs.groupBy(*by, F.col(c).alias("label")).agg(F.count(F.lit(1)).alias(name))
    m = one(a, "na").join(one(b, "nb"), [*by, "label"])
    if labels is not None:
        m = m.where(F.col("label").isin(*labels))
    chance = m.groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    out = n.join(chance, by, "left").withColumn("expected", F.coalesce("products", F.lit(0.0)) / (F.col("n") * F.col("n")))
    value = (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))
    fine = (F.col("expected") < 1 - 1e-12) & (F.col("n") >= (2 if undefined is None else 1))
    return out.select(*by, "n", "observed", "expected", F.when(fine, value).otherwise(F.lit(undefined).cast("double")).alias("kappa"))


def label_agreement(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, n_same, agreement) of two raters' labels."""
    out = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))
    return out.withColumn("agreement", ratio(F.col("n_same"), F.col("n")))


def identity_check(pairs: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Pairs of raters whose labels are all the same over ``least`` rows or more, which no two people achieve."""
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_exact"))
    return out.select("*", ratio(F.col("n_exact"), F.col("n")).alias("exact_fraction"), ((F.col("n") >= least) & (F.col("n_exact") == F.col("n"))).alias("suspicious"))


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Items of two rater files side by side; fails if either file lacks an item of the other."""
    w = a.withColumn("_in_a", F.lit(1)).alias("a").join(b.withColumn("_in_b", F.lit(1)).alias("b"), key, "full_outer")
    whole = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), F.raise_error(F.concat(F.lit("item in one file only: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return w.where(whole).drop("_in_a", "_in_b")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that one side lacks, "missing" from b or "unexpected" in b."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("unexpected").alias("side")))


def ownership_violations(annotations: DataFrame, index: DataFrame) -> DataFrame:
    """Annotations whose article is not in the index or is there under another source."""
    i = index.select(F.col("id").alias("article_id"), F.col("source").alias("index_source"))
    return annotations.join(i, "article_id", "left").where(F.col("index_source").isNull() | (F.col("index_source") != F.col("source")))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def answer_key_problems(rows: DataFrame, key: DataFrame) -> DataFrame:
    """(item_id, problem): rated items without an answer key, keys without an item, and stimuli that were changed since."""
    r, k = rows.select("item_id", F.col("stimulus_sha256").alias("of_row")), key.select(F.col("item_id"), F.col("stimulus_sha256").alias("of_key"))
    both = r.withColumn("_r", F.lit(True)).join(k.withColumn("_k", F.lit(True)), "item_id", "full_outer")
    problem = F.when(F.col("_k").isNull(), "no key").when(F.col("_r").isNull(), "no item").when(~F.col("of_row").eqNullSafe(F.col("of_key")), "stimulus changed")
    return both.select("item_id", problem.alias("problem")).where("problem is not null")


def score_differences(stored: DataFrame, scored: DataFrame, key: str, score: str, tolerance: float = 0.0) -> DataFrame:
    """(key, stored, scored, difference) of the models that both sides have and whose scores differ by more than ``tolerance``."""
    s, n = stored.select(key, F.col(score).alias("stored")), scored.select(key, F.col(score).alias("scored"))
    out = s.join(n, key).withColumn("difference", F.col("scored") - F.col("stored"))
    return out.where(F.abs("difference") > tolerance)


def sentinel_rows(results: DataFrame, macro: str, per_category: str) -> DataFrame:
    """Results whose macro score is 0 although a category has one: files from before macro scores were kept."""
    return results.where((F.col(macro) == 0) & F.coalesce(F.exists(F.map_values(per_category), lambda v: v > 0), F.lit(False)))


def annotation_row_issues(rows: DataFrame, choices: dict[str, list[str]], system_fields: list[str]) -> DataFrame:
    """(item_id, issue): leaked system fields, answers outside their choices, repeated items."""
    leaked = [f for f in system_fields if f in rows.columns]
    dup = F.count(F.lit(1)).over(Window.partitionBy("item_id")) > 1
    found = [F.when(dup, F.lit("repeated item"))] + [F.lit(f"leaked field {f}") for f in leaked]
    found += [F.when(F.col(f).isNotNull() & (F.trim(f) != "") & ~F.col(f).isin(*v), F.lit(f"answer not allowed in {f}")) for f, v in choices.items() if f in rows.columns]
    return rows.select("item_id", F.array_compact(F.array(*found)).alias("issues")).select("item_id", F.explode("issues").alias("issue"))
