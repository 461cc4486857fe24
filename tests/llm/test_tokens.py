"""Ids are those of the vocabulary's own merge routine, whichever way a word is looked up."""

import os
import random

import pytest

from peerlume.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.DEFAULT_FOLDER), reason="no vocabularies")

TEXTS = [
    "The referee's report isn't  long.\r\n\tIt has 12,345 words — or so!",
    "Größe, naïve café; 数据分析方法和结果。これは文章です 한국어 문장",
    "", None, " ", "　  x", "<|endoftext|> is ordinary text", "a" * 500 + " " + "=" * 300 + "数" * 80, "🧬🧬 family 👩‍👩‍👧",
]


def plain(text):
    import tiktoken

    enc = tiktoken.Encoding("plain", pat_str=tokens.plain_pattern().pattern, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    return enc.encode_ordinary(text or "")


def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    out = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(words, k=40))) for i in range(60)]
    return out + out[:12] + [(None, "null key, rareword"), (None, "null key, another")]  # repeated keys and NULL keys


@pytest.mark.parametrize("literal_words", [100_000, 40, 0])
def test_ids_by_table_and_by_join(spark, literal_words):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    enc = tokens.Encoder.fit(df, literal_words=literal_words)
    assert enc.complete == (literal_words == 100_000)
    want = sorted((i if i is not None else -1, plain(t)) for i, t in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in enc.encode(df, "doc_id").collect()) == want
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in enc.lengths(df, "doc_id").collect()) == [(i, len(x)) for i, x in want]


def test_decoding_gives_the_text_back(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    got = tokens.Encoder.fit(df).encode(df, "doc_id").select("doc_id", tokens.decode(tokens.F.col("ids")).alias("back")).collect()
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((i or -1, t or "") for i, t in rows())
