import pytest
from pyspark.sql import functions as F

from peerlume.functions import keys, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, doi, paper",
    [
        ("10.7554/eLife.20075157.1", "10.7554/elife.20075157.1", "10.7554/elife.20075157"),
        (" doi:10.7717/PEERJ.20128565. ", "10.7717/peerj.20128565", "10.7717/peerj.20128565"),
        ("http://doi.example/10.12688/F1000RESEARCH.20021732.2/", "10.12688/f1000research.20021732.2", "10.12688/f1000research.20021732"),
        ("10.1038%2Fs41467–200–00867–2​", "10.1038/s41467-200-00867-2", "10.1038/s41467-200-00867-2"),
        ("10.0000/unknown", None, None), ("n/a", None, None), ("", None, None), (None, None, None),
    ],
)
def test_dois(spark, raw, doi, paper):
    assert one(spark, raw, keys.canonical_doi) == doi
    assert one(spark, raw, keys.manuscript_of_doi) == paper


@pytest.mark.parametrize(
    "raw, paper",
    [
        ("elife:20075157v1", "10.7554/elife.20075157"), ("F1000:10.12688_F1000RESEARCH.20021551.1", "10.12688/f1000research.20021551"),
        ("plos: 10.1371/journal.pmed.20004111", "10.1371/journal.pmed.20004111"), ("nature:s41467-200-00867-2", "10.1038/s41467-200-00867-2"), (" ", None), (None, None),
    ],
)
def test_ids(spark, raw, paper):
    assert one(spark, raw, keys.manuscript_of_id) == paper


def test_tokens_need_whole_ascii_words(spark):
    assert one(spark, "The protéine ab A1c_ dose-42 the", text.match_tokens) == ["the", "dose"]
    assert one(spark, "The DOSE of the dose", text.retrieval_tokens) == ["dose", "dose"]


def test_decisions_in_order_of_precedence(spark):
    for letter, want in [("major and Minor Revision", "minor_revision"), ("Essential revisions", "major_revision"), ("we accept", "accept"), ("accept after revision", "unknown"), (None, "unknown")]:
        assert one(spark, letter, text.decision_of_letter) == want


def test_null_evidence_rules_nothing_out(spark):
    d = spark.createDataFrame([("conceded", None), ("partial", False), ("rebutted", True), (None, True)], "s string, e boolean")
    assert [r[0] for r in d.select(text.was_valid(F.col("s"), F.col("e"))).collect()] == [True, False, False, False]


def test_stance_follows_the_part_about_the_concern(spark):
    d = spark.createDataFrame([("the antibody dilution is missing", "We respectfully disagree on style. We have added the antibody dilution.", "unclear"), ("the antibody dilution", "We agree.", "unclear"), ("x", None, "unclear")], "c string, r string, s string")
    assert [r[0] for r in d.select(text.fixed_stance(F.col("c"), F.col("r"), F.col("s"))).collect()] == ["conceded", "unclear", "unclear"]


def test_dates_and_sections(spark):
    assert one(spark, "2020-05-01T10:00", text.normalized_date) == "2020-05-01"
    assert one(spark, "2019", text.normalized_date) == "2019-01-01"
    assert one(spark, "Materials and Methods.", text.section_key) == "methods"
    assert one(spark, "Data & code", text.section_key) == "data___code"
    assert one(spark, "f1000 note", text.doi_token) == "f1000-note"
