"""Samples, comparisons and hashed draws in closed forms."""

from pyspark.sql import functions as F

from peerlume.functions import text as T
from peerlume.operators import export, match, profile, split, stats, validate


def test_even_sample_gives_the_first_groups_one_more(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(99, None)], "no bigint, journal string")
    got = [r.journal for r in split.even_sample(df, "no", "journal", 8).collect()]
    assert sorted(got) == ["a"] * 3 + ["b"] * 3 + ["c"] * 2
    assert split.even_sample(df.where("false"), "no", "journal", 8).count() == 0
    assert split.even_sample(df, "no", "journal", 2).count() == 2


def test_sign_flips_are_fair(spark):
    p = lambda diffs: stats.sign_flip_sampled(spark.createDataFrame([("g", d) for d in diffs], "g string, d bigint"), ["g"], "d", draws=2000).first().p
    assert p([0, 0]) == 1.0
    assert p([1] * 60) < 0.001
    assert 0.6 < p([1, -1] * 40 + [2, -2] * 40 + [1]) <= 1.0  # 161 pairs, next to no difference
    assert abs(p([1] * 60 + [-1] * 40) - 0.057) < 0.02  # a binomial tail


def test_pairs_of_models_and_rankings(spark):
    s = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5), ("a", 2, 0.2), ("b", 2, 0.4), ("c", 2, 0.4)], "m string, u int, f double")
    got = {(r.model_a, r.model_b): (r.n, r.a_wins, r.b_wins, r.ties) for r in stats.model_pairs(s, "m", "u", "f").collect()}
    assert got == {("a", "b"): (2, 0, 1, 1), ("a", "c"): (1, 0, 1, 0), ("b", "c"): (1, 0, 0, 1)}
    ranks = stats.renumbered(spark.createDataFrame([(7, "x"), (3, "y")], "rank int, m string"), "rank", "m")
    assert {r.m: r["rank"] for r in ranks.collect()} == {"y": 1, "x": 2}


def test_sentinels_and_answer_keys(spark):
    r = spark.createDataFrame([("a", 0.0, {"x": 0.5}), ("b", 0.0, {"x": 0.0}), ("c", 0.0, None), ("d", 0.3, {"x": 0.5})], "m string, macro double, per map<string,double>")
    assert [x.m for x in validate.sentinel_rows(r, "macro", "per").collect()] == ["a"]
    rows = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", None)], "item_id string, stimulus_sha256 string")
    key = spark.createDataFrame([("2", "g"), ("3", None), ("4", "h")], "item_id string, stimulus_sha256 string")
    assert {r.item_id: r.problem for r in validate.answer_key_problems(rows, key).collect()} == {"1": "no key", "2": "stimulus changed", "4": "no item"}


def test_costs_and_examples(spark):
    a = spark.createDataFrame([("s", "t" * 10, "a" * 30, {"x": "y" * 100, "z": None}), ("s", None, None, None)], "source string, title string, abstract string, sections map<string,string>")
    chars = profile.article_chars(F.col("title"), F.col("abstract"), F.col("sections"))
    r = profile.input_cost(a, chars, 60, 1.0, 2.0, "source").first()
    assert (r.n, r.tokens, r.output_tokens) == (2, 15, 3000) and abs(r.cost - (15 + 6000) / 1e6) < 1e-12
    assert export.error_examples(a, "abstract", 7).first().abstract == "a" * 7


def test_urls_and_tokens(spark):
    d = spark.createDataFrame([("10.12688/F1000Research.157738.2",), ("10.12688/other.1.2",), ("10.1/x/y",), (None,)], "doi string")
    got = d.select(T.xml_url(F.col("doi")).alias("u"), T.article_token(F.col("doi")).alias("t"), T.is_root_doi(F.col("doi")).alias("r")).collect()
    assert [r.u for r in got] == ["https://f1000research.com/articles/157738/2/xml", None, None, None]
    assert [r.t for r in got] == ["f1000research.157738.2", "other.1.2", "y", None] and [r.r for r in got] == [True, True, False, False]


def test_optimal_beats_greedy(spark):
    edges = spark.createDataFrame([("m", 1, 1, 1, 0.9), ("m", 1, 1, 2, 0.8), ("m", 1, 2, 1, 0.8)], "model string, entry_no bigint, tool_no bigint, ref_no bigint, score double")
    assert match.greedy_matches(edges, 0.5).count() == 1
    assert {(r.tool_no, r.ref_no) for r in match.matches(edges, match.MatcherConfig(threshold=0.5, backend="embedding")).collect()} == {(1, 2), (2, 1)}
