import json

import pytest
from pyspark.sql import functions as F

from peerlume.operators import export, model, parse, report, validate
from peerlume.sources import readers
from peerlume.streaming import incremental


def test_jsonl_modes(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    open(p, "w").write('{"id": "x"}\n\nnot json\n')
    assert readers.read_jsonl(spark, p, "id string", skip_invalid=True).count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p, "id string").collect()
    assert readers.count_valid(readers.read_permissive(spark, p, "id string").cache(), F.col("id").isNotNull()).first()[:] == (2, 1, 1)
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none"))
    assert readers.read_jsonl(spark, str(tmp_path / "none"), allow_missing=True).count() == 0


def test_tool_outputs(spark):
    raw = spark.createDataFrame([("a", None, ["x", " ", "y"]), ("", "b", ['{"text": "t"}', '{"concern_text": ""}']), (None, None, ["z"])], readers.TOOL_SCHEMA)
    assert {r.article_id: r.concerns for r in readers.tool_map(raw).collect()} == {"a": ["x", "y"], "b": ["t", ""]}
    assert {r.article_id: r.concerns for r in readers.audit_tool_map(raw).collect()}["b"] == ["t"]
    with pytest.raises(Exception, match="repeated"):
        readers.tool_map(raw.union(raw)).collect()


def test_frozen_ids(tmp_path):
    p = tmp_path / "f.json"
    for content, fine in (({"ids": ["a", "b"]}, True), ({"test_ids": ["a"]}, True), ({"ids": ["a"], "test_ids": ["b"]}, False), ({"ids": ["a", "a"]}, False), ({"ids": []}, False), ({}, False)):
        p.write_text(json.dumps(content))
        if fine:
            assert readers.frozen_ids(str(p))
        else:
            with pytest.raises(ValueError):
                readers.frozen_ids(str(p))


def test_package_check(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.txt").write_text("one")
    (tmp_path / "pkg/b.txt").write_text("two")
    found = readers.artifacts(spark, str(tmp_path / "pkg"))
    listed = spark.createDataFrame([(r.path, r.sha256 if r.path == "a.txt" else "0", r.bytes) for r in found.collect()] + [("c.txt", "0", 1)], found.schema)
    assert {r.path: r.problem for r in readers.package_problems(found, listed).collect()} == {"b.txt": "changed", "c.txt": "missing"}


def test_atomic_replacement(spark, tmp_path):
    p = str(tmp_path / "t")
    for n in (3, 5):
        readers.replace_atomically(spark.range(n), p)
        assert spark.read.parquet(p).count() == n


def test_answers():
    assert parse.answer_texts('Sure:\n```json\n["a", {"text": "b"}]\n```') == ["a", "b"]
    assert parse.answer_texts('x ["a"] y') == ["a"]
    assert parse.answer_texts("1. [Design] too few mice\n- Other: no control") == ["too few mice", "no control"]
    assert parse.answer_texts(None) == []


def test_jats_and_html(spark):
    xml = """<article><front><article-id pub-id-type="doi">10.1/x</article-id><subject>S</subject><article-title>A <i>b</i></article-title><pub-date pub-type="epub"><year>2020</year><month>3</month></pub-date></front>
    <body><sec><title>Results</title><p>It works.</p></sec></body><sub-article article-type="decision-letter"><front-stub><article-title>Letter</article-title></front-stub><body><p>Fine.</p></body></sub-article></article>"""
    rows = parse.parse_jats(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, x string"), "k", "x").orderBy("k").collect()
    assert (rows[0].doi, rows[0].title, rows[0].published, rows[0].letters) == ("10.1/x", "A b", "2020-03-01", ["Fine."])
    assert [s.title for s in rows[0].sections] == ["Results"] and rows[1].error and rows[2].error
    assert parse.html_sections_of("<h2>Aim</h2><p>To &amp; fro<script>x</script></p>") == [("Aim", "To & fro")]


def test_letters_are_cut_at_headings(spark):
    d = spark.createDataFrame([("Hello. Reviewer 1: good\nReferee #2 (remarks): bad",), ("no heading",), ("  ",)], "l string")
    assert [r[0] for r in d.select(parse.reviewer_blocks(F.col("l"))).collect()] == [["Reviewer 1: good", "Referee #2 (remarks): bad"], ["no heading"], []]


def test_clients_are_retried_and_reported(spark):
    def broken(_):
        raise RuntimeError("down")

    d = spark.createDataFrame([(1, "METHODS:\nx")], "k int, p string")
    assert model.reviewed(d, "k", "p", broken).first().error == "down"
    assert model.reviewed(d, "k", "p").first().concerns == ["Methods should be described in more detail."]


def test_blocked_fields_at_any_depth(spark):
    schema = spark.createDataFrame([], "id string, concerns bigint, a array<struct<concern_text:string,m:map<string,struct<title:string>>>>").schema
    assert export.blocked_paths(schema, {"concern_text", "title", "concerns"}) == ["a[].concern_text", "a[].m{}.title"]


def test_rater_files_must_have_the_same_items(spark):
    a, b = (spark.createDataFrame([(i, x) for i in ids], f"item_id int, {n} string") for ids, n, x in (((1, 2), "a", "y"), ((1, 3), "b", "y")))
    with pytest.raises(Exception, match="one file only"):
        validate.aligned(a, b, "item_id").collect()
    assert {(r.item_id, r.side) for r in validate.set_differences(a, b, "item_id").collect()} == {(2, "missing"), (3, "unexpected")}


def test_kappa_where_chance_is_certain(spark):
    p = spark.createDataFrame([(1, "x", "x"), (1, "x", "x")], "g int, a string, b string")
    assert validate.kappa(p, ["g"]).first().kappa is None
    assert validate.kappa(p, ["g"], undefined=0.0).first().kappa == 0.0


def test_state_never_moves_back_and_repeats_change_nothing(spark, tmp_path):
    state = incremental.StateTable(spark, str(tmp_path / "state"))
    batch = spark.createDataFrame([("s", "1", None), ("s", "2", None)], "source string, id string, date date")
    for k in (0, 0, 1):
        state.upsert(batch, k)
    assert state.read().count() == 2


def test_lock_is_exclusive(tmp_path):
    with incremental.single_writer(str(tmp_path / "l")) as first, incremental.single_writer(str(tmp_path / "l")) as second:
        assert first and not second


def test_reports():
    assert "| 1 | a | v | 0.5000 | 0.2500 |" in report.leaderboard_markdown([{"rank": 1, "tool": "a", "version": "v", "f1": 0.5, "recall": 0.25}])
    assert report.drift({"a": "x\n"}, {"a": "x  \r\n"}) == {} and report.drift({"a": "x"}, {"b": "x"}) == {"a": "missing", "b": "unexpected"}
    assert report.documentation_problems("1,234 articles", {"articles": 1234, "concerns": 9}) == ["concerns: 9 not found"]
