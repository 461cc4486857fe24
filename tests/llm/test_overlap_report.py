"""Counts of overlaps agree with the pairs themselves, also where one DOI or text is on very many rows."""

from collections import defaultdict

from peerlume.llm import overlap

SCHEMA = "entry_no bigint, doi string, title string, abstract string, split string, source string"


def rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    out = []
    for i in range(120):  # a hot DOI with two texts, one of them hot by itself
        out.append((i, "10.1234/hot", base if i % 2 else base + " lambda", None if i % 3 else "n/a", ("train", "val", "test")[i % 3 if i % 5 else 0], "ab"[i % 2]))
    out += [
        (200, None, base + " mu", None, "train", "a"), (201, "10.1234/x.1", "other words", "here", "train", "a"), (202, "doi:10.1234/X.1", "no such", "text", "val", "a"),
        (203, "unknown", None, None, "train", "b"), (204, "unknown", "", " ", "test", "b"), (205, None, "lonely title", "of a record", "test", None), (206, None, "x", None, None, "a"),
    ]
    return out


def test_report_counts_the_pairs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    pairs = defaultdict(int)
    for r in overlap.overlaps(df).collect():
        pairs[r.eval_no] += 1
    want = defaultdict(lambda: [0, 0, 0])
    for no, _, _, _, split, source in rows():
        if split in ("val", "test"):
            for i, x in enumerate((1, pairs[no] > 0, pairs[no])):
                want[split, source][i] += x
    got = {(r.split, r.source): [r.eval_rows, r.overlapping_rows, r.overlapping_pairs] for r in overlap.overlap_report(df, ("split", "source")).collect()}
    assert got == dict(want) and got["test", None] == [1, 0, 0] and got["val", "a"][2] > 100


def test_empty(spark):
    assert overlap.overlap_report(spark.createDataFrame([], SCHEMA), ("split",)).count() == 0
