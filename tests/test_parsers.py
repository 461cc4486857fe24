"""Parsers, readers and writers that no query over the tables reaches."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from peerlume.functions import text as T
from peerlume.operators import export, model, parse, profile, report, stats
from peerlume.sources import readers
from peerlume.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_prompt_cuts_long_sections_in_order(spark):
    sections = F.create_map(F.lit("discussion"), F.lit("d" * 3001), F.lit("introduction"), F.lit("short"), F.lit("other"), F.lit("never shown"))
    shown = one(spark, parse.prompt_text(F.lit("A title"), F.lit(""), sections))
    assert shown == "TITLE: A title\n\nINTRODUCTION:\nshort\n\nDISCUSSION:\n" + "d" * 3000 + "\n[…truncated]"


def test_extracted_rows_are_cleaned(spark):
    rows = spark.createDataFrame([([("  too short ", "x", "y"), ("short", "other", "minor"), ("a long enough text", "design_flaw", "major")],)], "r array<struct<text:string,category:string,severity:string>>")
    got = rows.select(parse.clean_extracted(F.col("r"), export.CATEGORIES, export.SEVERITIES).alias("c")).first().c
    assert [tuple(x) for x in got] == [("a long enough text", "design_flaw", "major")]
    longer = spark.createDataFrame([([("just ten ch", "x", "y")],)], rows.schema)
    assert [tuple(x) for x in longer.select(parse.clean_extracted(F.col("r"), export.CATEGORIES, export.SEVERITIES).alias("c")).first().c] == [("just ten ch", "other", "minor")]


def test_docx_and_html(spark):
    xml = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    d = spark.createDataFrame([(bytearray(buffer.getvalue()),), (bytearray(b"no zip"),), (None,)], "b binary")
    assert [r[0] for r in d.select(parse.docx_text(F.col("b"))).collect()] == ["One two\nThree", None, None]
    page = spark.createDataFrame([("<h1>Aim</h1><p>A &lt; B</p><style>x</style><h2>End</h2>text",), (None,)], "p string")
    assert [[tuple(s) for s in r[0]] for r in page.select(parse.html_sections(F.col("p"))).collect()] == [[("Aim", "A < B"), ("End", "text")], []]


def test_pdf_blocks_skip_cover_and_responses(spark):
    body = "Cover page. Reviewer #1: " + "a" * 200 + "\nReviewer #2: tiny\nReviewer 3 (Remarks): " + "b" * 200 + "\nResponse to reviewers\nReviewer #1: " + "c" * 300
    blocks = one(spark, parse.pdf_blocks(F.lit(body)))
    assert [b[:11] for b in blocks] == ["Reviewer #1", "Reviewer 3 "] and not any("c" * 20 in b for b in blocks)


def test_headings_of_all_kinds(spark):
    letter = "Hi. Review Report from Reviewer 1: x Referee - 2. y Review 3 - z reviewer#4 (Expert): w Reviewer five: v"
    assert [b.split()[0] for b in one(spark, parse.reviewer_blocks(F.lit(letter)))] == ["Review", "Referee", "Review", "reviewer#4"]


def test_versions_and_flags(spark):
    key = [one(spark, T.version_key(F.lit(v))) for v in ("v1.10", "1.9", "2.x")]
    assert key == [[1, 10], [1, 9], [2, 0]] and key[0] > key[1]
    assert [one(spark, T.evidence_flag(F.lit(v))) for v in (" Yes", "0", "maybe", None)] == [True, False, None, None]
    assert profile.price_of("m-1-large", {"m": 1.0, "m-1": 2.0}, 9.0) == 2.0 and profile.price_of("z", {"m": 1.0}, 9.0) == 9.0


def test_result_files_that_cannot_be_read_are_passed_over(spark, tmp_path):
    for name, content in (("a.json", json.dumps({"tool": "x", "f1": 0.5})), ("b.json", "{broken"), ("c.json", json.dumps({"tool": "y"}))):
        (tmp_path / name).write_text(content)
    assert [(r.tool, r.file) for r in readers.read_results(spark, str(tmp_path), "tool string, f1 double", ["tool", "f1"]).collect()] == [("x", "a.json")]


def test_frozen_files_in_order(tmp_path):
    (tmp_path / "v4").mkdir()
    legacy = tmp_path / "legacy.json"
    with pytest.raises(FileNotFoundError):
        readers.frozen_path(str(tmp_path), "v4", str(legacy))
    for p in (legacy, tmp_path / "frozen_test_ids.json", tmp_path / "v4" / "frozen_test_ids.json"):
        p.write_text("{}")
        assert readers.frozen_path(str(tmp_path), "v4", str(legacy)) == str(p)


def test_last_line_wins_and_resume(spark):
    raw = spark.createDataFrame([("a", ["x"], 1), ("a", ["y", '{"text": "z"}'], 2), (None, ["q"], 3)], "article_id string, concerns array<string>, line int")
    assert [(r.article_id, r.concerns) for r in readers.last_wins_tool_map(raw, "line").collect()] == [("a", ["y"])]
    ids = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "id string")
    assert [r.id for r in readers.known_ids(ids).collect()] == ["a"]
    with pytest.raises(Exception, match="row without id"):
        readers.known_ids(ids, strict=True).collect()
    prompts = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in model.resumed(prompts, ids.where("id = 'a'"), "id").collect()] == ["b"]


def test_configurations_and_columns_of_exports(spark, tmp_path):
    df = spark.createDataFrame([("1", "train"), ("2", None)], "id string, split string")
    readers.write_configs({"default": df, "ids": df.select("id", "split")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "default")).where("split = 'train'").count() == 1
    with pytest.raises(ValueError, match="not allowed"):
        readers.write_csv(df, str(tmp_path / "x.csv"), ["id"])
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.parquet")


def test_mixed_matchers_are_refused(spark):
    runs = spark.createDataFrame([("a", "greedy", 1, 1), ("b", "hungarian", 1, 1), ("c", "other", 0, 1)], "tool string, algorithm string, n_ref int, n_tool int")
    with pytest.raises(ValueError, match="different matchers"):
        stats.homogeneous(runs, ["algorithm"])
    assert stats.homogeneous(runs.where("tool <> 'b'"), ["algorithm"]).count() == 2


def test_articles_to_extract_again(spark):
    rows = spark.createDataFrame([(1, [], "letter"), (2, ["c"], "letter"), (3, None, "letter"), (4, [], "  ")], "k int, concerns array<string>, decision_letter_raw string")
    assert sorted(r.k for r in incremental.without_concerns(rows).collect()) == [1, 3]


def test_embeddings_once_per_text(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "t string")
    got = model.embedded(texts, "t", lambda ts: [[float(len(x))] for x in ts]).collect()
    assert sorted((r.t, r.embedding) for r in got) == [("a", [1.0]), ("bb", [2.0])]


def test_notes_cards_and_fingerprints():
    note = report.matcher_note("jaccard", 0.195, "greedy")
    assert report.with_note(report.with_note("run", note), note) == f"run {note}"
    assert report.input_fingerprint([{"b": 1, "a": 2}]) == report.input_fingerprint([{"a": 2, "b": 1}]) != report.input_fingerprint([{"a": 1, "b": 2}])
    assert "- n<1K" in report.dataset_card("set", {"train": 3}, "n<1K", "cc0-1.0") and "f1      0.5000" in report.console_report({"f1": 0.5, "recall": 1})
    assert [m["path"] for m in report.release_manifest({"b": b"2", "a": b"1"})] == ["a", "b"] and report.identity_code(True) == "identical"
