"""Redaction keeps all else, leaves no text open, and long runs of characters take linear time."""

import time

from peerlume.llm import privacy

SCHEMA = "table_name string, row_no bigint, field string, item bigint, text string"
MARKS = {"email": "[EMAIL]", "phone": "[PHONE]", "street_address": "[ADDRESS]", "id_number": "[ID]", "person_name": "[NAME]"}


def redact(spark, rows):
    texts = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.row_no or -1, r.text or "") for r in privacy.redacted(texts, privacy.personal_places(texts), MARKS).collect())


def test_rows_without_a_number_and_repeated_rows_are_redacted(spark):
    rows = [("t", None, "f", 0, "Write to ann@lab.example now."), ("t", None, "f", 0, "Nothing here; but b.c@x.example."), ("t", 3, "f", 0, "a@b.example  \r\n tab\t end")] + [("t", 4, "f", 0, "x@y.example")] * 2
    assert redact(spark, rows) == sorted([(-1, "Write to [EMAIL] now."), (-1, "Nothing here; but [EMAIL]."), (3, "[EMAIL]  \r\n tab\t end"), (4, "[EMAIL]"), (4, "[EMAIL]")])


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1-" * 100_000, "A" * 200_000, "Ab" * 100_000, "12 " * 60_000, "x." * 100_000):
        began = time.time()
        privacy.candidates(text)
        assert time.time() - began < 4, text[:4]


def test_an_address_after_a_long_run_is_found():
    text = "b" * 500 + " mail me: " + "c" * 60 + "@site.example"
    assert [c[0] for c in privacy.candidates(text)] == ["email"]
