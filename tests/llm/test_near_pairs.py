"""Nearly equal texts are found exactly: the pairs are those of comparing every row with every other."""

import random

from pyspark.sql import functions as F

from peerlume.llm import history, overlap

SCHEMA = "entry_no bigint, doi string, title string, abstract string, split string"


def _edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """Pairs of entry numbers of a train and another row that meet the criterion."""
    sets = [(no, split, set((t or "").split()), set((a or "").split())) for no, _, t, a, split in rows]
    return {
        (x, y)
        for x, sx, tx, ax in sets if sx == "train" and tx | ax
        for y, sy, ty, ay in sets if sy != "train" and ty | ay
        and min(_jaccard(tx, ty), _jaccard(ax, ay), _jaccard(tx | ax, ty | ay)) >= overlap.SIMILAR
    }


def corpus(seed=5, family=60, rest=140):
    """A family that is 30 % of all rows, each an edit of one text, among pairs of edited rows of other texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    split = lambda i: ("train", "test", "val")[i % 3]
    title, abstract = rng.sample(vocabulary, 10), rng.sample(vocabulary, 100)
    rows = [(i, None, " ".join(_edited(rng, title, i % 2)), " ".join(_edited(rng, abstract, rng.choice([1, 8, 9, 20]))), split(i)) for i in range(family)]
    for i in range(family, family + rest, 2):
        t, a = rng.sample(vocabulary, 10), rng.sample(vocabulary, 100)
        rows += [(i, None, " ".join(t), " ".join(a), "train"), (i + 1, None, " ".join(_edited(rng, t, rng.randrange(3))), " ".join(_edited(rng, a, rng.randrange(16, 26))), "test")]
    return rows


def found(spark, rows):
    return {tuple(r) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_pair_of_a_large_family_and_of_edited_rows(spark):
    rows = corpus()
    want = brute_force(rows)
    assert len(want) > 500 and any(x >= 60 for x, _ in want)
    assert found(spark, rows) == want


def test_cells_of_a_shared_key(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", 7)
    rows = corpus(seed=6)
    assert found(spark, rows) == brute_force(rows)


def test_missing_titles_meet_by_abstract(spark):
    rng = random.Random(1)
    a = [f"w{i}" for i in range(50)]
    rows = [(1, None, None, " ".join(a), "train"), (2, None, "", " ".join(_edited(rng, a, 10)), "val"), (3, None, "a title", " ".join(a), "val")]
    assert found(spark, rows) == {(1, 2)}


def test_batches_against_history_find_what_brute_force_finds(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    split = lambda i: "train" if i < 400 else "test"
    words = [(rng.sample(vocabulary, 10), rng.sample(vocabulary, 100)) for _ in range(400)]
    # in the history half of the articles share title words; the incoming ones are edits at J = 0.64 - 0.75 and just below
    words = [(t[:3] + ["on", "the", "new", "way"] + t[7:], a) if i % 2 else (t, a) for i, (t, a) in enumerate(words)]
    words += [(_edited(rng, t, rng.randrange(3)), _edited(rng, a, rng.randrange(14, 25))) for t, a in words[:200]]
    rows = [(i, None, " ".join(t), " ".join(a), split(i)) for i, (t, a) in enumerate(words)]
    want = {y for _, y in brute_force(rows)}
    assert 50 < len(want) < 200
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(None).cast("string"))
    counts = overlap.word_counts(df, F.col("title"))
    past = history.History(spark)
    past.add(history.records(df.where("split = 'train'"), counts, "entry_no", F.lit(history.BEFORE_ALL)))
    new = df.where("split = 'test'").withColumn("batch", F.col("entry_no") % 2)
    recs = history.records(new, counts, "entry_no", F.col("entry_no"), keep=("batch",))
    assert {r.rec for r in history.found_in_batches(past, recs, "batch", [0, 1]).collect()} == want


def test_short_titles_without_abstracts(spark):
    rows = [(1, None, "zinc uptake", None, "train"), (2, None, "zinc uptake kinetics", None, "test"), (3, None, "zinc", None, "test"), (4, None, "lead", None, "train")]
    assert found(spark, rows) == {(1, 2)} == brute_force(rows)
