"""Runs of the history: even blocks, merged by size, old ones deleted, and the same answers throughout."""

import os
import random

from pyspark.sql import functions as F

from peerlume.llm import history, overlap
from tests.llm.test_near_pairs import SCHEMA, _edited, brute_force

def test_many_batches_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_ENTRIES", 200)
    monkeypatch.setattr(history, "CELL", 5)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(20_000)]  # as many keys as a real corpus has, so that blocks can be even
    words = [(rng.sample(vocabulary, 9), rng.sample(vocabulary, 60)) for _ in range(240)]
    hot = words[0]
    new = [(_edited(rng, t, rng.randrange(2)), _edited(rng, a, rng.randrange(6, 16))) for t, a in words[:60]]
    new += [(hot[0], _edited(rng, hot[1], rng.randrange(1, 14))) for _ in range(40)]  # a title that two fifths of all new records share
    # each record is compared with all before it, of whatever batch
    everything = [(i, None, " ".join(t), " ".join(a), "") for i, (t, a) in enumerate(words + new)]

    want = set()
    for i in range(len(words), len(everything)):
        before = [(*r[:4], "train") for r in everything[:i]]
        if brute_force([*before, (*everything[i][:4], "test")]):
            want.add(i)
    df = spark.createDataFrame(everything, SCHEMA).withColumn("id", F.lit(None).cast("string"))
    counts = overlap.word_counts(df, F.col("title"))
    past = history.History(spark)
    past.add(history.records(df.where(F.col("entry_no") < len(words)), counts, "entry_no", F.lit(history.BEFORE_ALL)))
    assert past.bits >= 3
    sizes = [r["count"] for r in spark.read.parquet(past.runs[0].near).groupBy("block").count().collect()]
    assert len(sizes) == 2**past.bits and max(sizes) <= 2 * sum(sizes) / len(sizes)
    first = past.runs[0].near
    recs = history.records(df.where(F.col("entry_no") >= len(words)).withColumn("batch", F.col("entry_no") % 6), counts, "entry_no", F.col("entry_no"), keep=("batch",))
    # batches in order of their records' numbers, so that "before" is the same for both
    recs = recs.withColumn("batch", F.floor((F.col("rec") - len(words)) / 17))
    got = {r.rec for r in history.found_in_batches(past, recs, "batch", list(range(6))).collect()}
    assert got == want and 60 <= len(got) < 100
    assert len(past.runs) <= history.COMPACT_AFTER + 1 and past.contents().count() == len(everything)
    folder = past.path.replace("file:", "")
    kept = {p for r in past.runs for p in (r.exact, r.near, *r.texts)}
    assert {f"{past.path}/{x}" for x in os.listdir(folder) if not x.startswith(".")} == kept and os.path.isdir(first.replace("file:", ""))
