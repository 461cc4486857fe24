"""Readers and writers: JSON lines, tool outputs, frozen ids, result files, annotation tables, packages."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schema of an article record and of its concerns.
CONCERN_SCHEMA = (
    "struct<concern_id:string,reviewer_num:int,concern_text:string,category:string,severity:string,author_response_text:string,author_stance:string,"
    "evidence_of_change:boolean,resolution_confidence:double,resolution:string,was_valid:boolean,raised_by_multiple:boolean,requires_figure_reading:boolean,"
    "extraction_trace_id:string,extraction_manifest_id:string,source:string,article_doi:string>"
)
ARTICLE_SCHEMA = (
    "id string, source string, doi string, title string, abstract string, subjects array<string>, editorial_decision string, revision_round int, published_date string, "
    "review_format string, has_author_response boolean, paper_text_sections map<string,string>, "
    "structured_references array<struct<id:string,authors:array<string>,year:string,title:string,journal:string>>, decision_letter_raw string, author_response_raw string, "
    f"concerns array<{CONCERN_SCHEMA}>, extraction_manifest_id string, schema_version string"
)
TOOL_SCHEMA = "article_id string, id string, concerns array<string>"

# The five sources and how they are collected.
SOURCE_CONFIG = [
    ("elife", "eLife", "10.7554", "jats"), ("plos", "PLOS", "10.1371", "jats"), ("f1000", "F1000Research", "10.12688", "jats"),
    ("peerj", "PeerJ", "10.7717", "html"), ("nature", "Nature Communications", "10.1038", "pdf"),
]


def exists(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a file or folder exists, on whatever file system the session (if any) sees."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return os.path.exists(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA, allow_missing: bool = False, skip_invalid: bool = False) -> DataFrame:
    """JSON lines under a schema. Blank lines are skipped; broken lines fail, or are dropped on request; a missing path fails, or is empty."""
    if not exists(path):
        if allow_missing:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_invalid else "FAILFAST").json(path)


def read_permissive(spark: SparkSession, path: str, schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """As :func:`read_jsonl`, with broken lines kept in ``_corrupt_record`` and the file's name beside each row."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_name"))


def count_valid(df: DataFrame, valid: Column) -> DataFrame:
    """(total, valid, invalid) of a permissive read; broken lines are invalid."""
    fine = F.col("_corrupt_record").isNull() & F.coalesce(valid, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(fine).alias("valid"), F.count_if(~fine).alias("invalid"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str = ARTICLE_SCHEMA) -> DataFrame:
    """Several splits with their name in ``benchmark_split``."""
    parts = [read_jsonl(spark, p, schema).withColumn("benchmark_split", F.lit(s)) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalised_concerns(c: Column) -> Column:
    """Texts of a tool's concerns, given as strings or as objects in JSON.

    The first element decides: lists of strings lose blanks, lists of objects keep empty texts;
    labels beside the text are ignored.
    """
    is_object = F.coalesce(F.get(c, 0).startswith("{"), F.lit(False))
    text = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.concern_text"), F.lit(""))
    objects = F.transform(F.filter(c, lambda x: x.startswith("{")), text)
    strings = F.filter(F.filter(c, lambda x: ~x.startswith("{")), lambda x: F.trim(x) != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(is_object, objects).otherwise(strings)


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` whose evaluation fails on a repeated key."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fine = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return df.join(n, key).where(fine).drop("_n")


def tool_map(raw: DataFrame, strict: bool = True) -> DataFrame:
    """(article_id, concerns) of a tool's output; rows without an id are skipped, repeated ids fail."""
    ids = F.coalesce(F.when(F.col("article_id") != "", F.col("article_id")), F.when(F.col("id") != "", F.col("id")))
    out = raw.select(ids.alias("article_id"), normalised_concerns(F.col("concerns")).alias("concerns")).where("article_id is not null")
    return assert_unique(out, "article_id") if strict else out


def audit_tool_map(raw: DataFrame) -> DataFrame:
    """As :func:`tool_map` with trimmed texts and blanks dropped in either form."""
    return tool_map(raw).withColumn("concerns", F.filter(F.transform("concerns", F.trim), lambda x: x != ""))


def last_wins_tool_map(raw: DataFrame, line: str) -> DataFrame:
    """(article_id, concerns): only plain strings, and of repeated ids the last line."""
    strings = F.filter("concerns", lambda x: ~x.startswith("{"))
    return raw.where("article_id is not null").groupBy("article_id").agg(F.max_by(strings, line).alias("concerns"))


def known_ids(df: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Distinct ids for resuming; a missing id fails if strict, else is passed over."""
    if strict:
        df = df.where(F.when(F.col(key).isNull() | (F.col(key) == ""), F.raise_error(F.lit("row without id"))).otherwise(F.lit(True)))
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()


def frozen_ids(path: str, split: str = "test", strict: bool = False) -> list[str]:
    """Ids of a frozen split from a small JSON file with ``ids`` and/or ``<split>_ids``."""
    found = json.loads(Path(path).read_text())
    lists = [found[k] for k in (["ids"] if strict else ["ids", f"{split}_ids"]) if k in found]
    if not lists:
        raise ValueError(f"{path}: no ids")
    if len(lists) == 2 and lists[0] != lists[1]:
        raise ValueError(f"{path}: ids and {split}_ids differ")
    ids = lists[0]
    if not isinstance(ids, list) or not ids or not all(isinstance(x, str) and x for x in ids) or len(set(ids)) != len(ids):
        raise ValueError(f"{path}: ids must be different non-empty strings")
    return ids


def frozen_path(root: str, version: str, legacy: str) -> str:
    """The first of version file, root file and legacy file that exists."""
    for p in (f"{root}/{version}/frozen_test_ids.json", f"{root}/frozen_test_ids.json", legacy):
        if exists(p):
            return p
    raise FileNotFoundError(root)


def read_results(spark: SparkSession, folder: str, schema: str, required: list[str]) -> DataFrame:
    """Result files, one JSON document each; unreadable ones and those without a required field are passed over."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    fine = F.col("_corrupt_record").isNull()
    for r in required:
        fine = fine & F.col(r).isNotNull()
    return df.withColumn("file", F.col("_metadata.file_name")).where(fine).drop("_corrupt_record")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rater files by suffix: .csv, .jsonl or .ndjson."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    raise ValueError(f"{path}: neither .csv nor .jsonl nor .ndjson")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with exactly the given columns; other columns are an error."""
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"columns not allowed: {', '.join(sorted(extra))}")
    df.select(*columns).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_configs(views: dict[str, DataFrame], path: str) -> None:
    """Each configuration as a table partitioned by split."""
    for name, df in views.items():
        df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")


def artifacts(spark: SparkSession, folder: str, manifest: str = "manifest.json") -> DataFrame:
    """(path, sha256, bytes) of the files in a package, the manifest excluded."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", f"^.*{folder.rstrip('/')}/", "")
    return f.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).where((F.col("path") != manifest) & ~F.col("path").rlike(r"(^|/)[._]"))


def package_problems(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, not listed, or changed."""
    m = manifest.withColumnsRenamed({"sha256": "sha256_m", "bytes": "bytes_m"})
    j = found.withColumn("_f", F.lit(True)).join(m.withColumn("_m", F.lit(True)), "path", "full_outer")
    problem = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "not listed").when((F.col("sha256") != F.col("sha256_m")) | (F.col("bytes") != F.col("bytes_m")), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside the target, then rename: readers see the old table or the new one."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    staging, old = f"{path}.staging", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(old), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(staging), fs_path(path))
    fs.delete(fs_path(old), True)


def source_dimension(spark: SparkSession) -> DataFrame:
    """The sources as a small table to join."""
    return spark.createDataFrame(SOURCE_CONFIG, "source string, name string, doi_prefix string, parser string")


def package_sources() -> list[str]:
    return [s for s, *_ in SOURCE_CONFIG]
