"""Consensus labels: planted annotators, both ways of estimating, and answers that say nothing."""

import random

from pyspark.sql import functions as F

from peerlume.functions.keys import category
from peerlume.llm import consensus

CLASSES = {"severity": ["major", "minor", "optional"], "stance": ["yes", "no"]}
SCHEMA = "item bigint, annotator string, severity string, stance string, at bigint"


def answers(spark, rows):
    return consensus.gather_answers(spark.createDataFrame(rows, SCHEMA), "item", "annotator", ["at"], {f: category(F.col(f)) for f in CLASSES}, CLASSES)


def labels(result, classes=CLASSES):
    return {(r.item, r.field): r.label for r in consensus.best_label(result.posteriors, classes).collect()}


def planted(seed=1, items=300):
    """Two careful annotators and three who mostly say "minor" whatever the truth is."""
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(items):
        t = (rng.choice(CLASSES["severity"]), rng.choice(CLASSES["stance"]))
        truth[i, "severity"], truth[i, "stance"] = t
        for k in range(5):
            careful = k < 2
            s = t[0] if rng.random() < (0.95 if careful else 0.2) else ("minor" if not careful else rng.choice(CLASSES["severity"]))
            y = t[1] if rng.random() < (0.95 if careful else 0.5) else rng.choice(CLASSES["stance"])
            rows.append((i, f"a{k}", s.title() if rng.random() < 0.3 else f" {s}", y, rng.randrange(10**6)))
    return truth, rows


def test_careful_annotators_outweigh_a_careless_majority(spark):
    truth, rows = planted()
    got = consensus.reliability_em(answers(spark, rows))
    found = labels(got)
    assert found.keys() == truth.keys()
    assert sum(found[k] == truth[k] for k in truth) / len(truth) > 0.93
    reliable = {(r.field, r.annotator): r.reliability for r in got.reliability().collect()}
    assert min(reliable["severity", a] for a in ("a0", "a1")) > 0.85 > 0.6 > max(reliable["severity", a] for a in ("a2", "a3", "a4"))


def test_joins_beyond_the_broadcast_give_the_same(spark):
    _, rows = planted(seed=2, items=80)
    a = answers(spark, rows)
    small, large = consensus.reliability_em(a), consensus.reliability_em(a, most_annotators=2)
    assert small.rounds == large.rounds and labels(small) == labels(large)
    one, two = ({(r.field, r.annotator): (r.votes, round(r.reliability, 9)) for r in x.reliability().collect()} for x in (small, large))
    assert one == two


def test_latest_answers_and_answers_that_say_nothing(spark):
    rows = [
        (1, "a", "major", "yes", 1), (1, "a", "Minor", None, 2), (1, "a", "Minor", None, 2),  # replaced, sent twice
        (2, "a", "major", "no", 1), (2, "a", " - ", "", 2),  # taken back: earlier answers count where nothing else is left
        (3, "a", "no such label", None, 1),
        (None, "a", "major", "yes", 1), (4, None, "major", "yes", 1),
    ]
    votes = {(r.item, r.field, r.annotator, r.label) for r in answers(spark, rows).votes().collect()}
    assert votes == {(1, "severity", "a", "minor"), (1, "stance", "a", "yes"), (2, "severity", "a", "major"), (2, "stance", "a", "no")}
    assert answers(spark, []).votes().count() == 0


def test_kappa_is_that_of_fleiss(spark):
    rows = [(i, f"a{k}", s, None, 1) for i, ss in enumerate((["major"] * 3, ["minor"] * 3, ["major", "minor", "minor"], ["optional"])) for k, s in enumerate(ss)]
    (r,) = consensus.agreement(answers(spark, rows)).collect()
    observed, expected = (1 + 1 + 1 / 3) / 3, (4 / 9) ** 2 + (5 / 9) ** 2
    assert (r.field, r.items) == ("severity", 3)
    assert abs(r.observed - observed) < 1e-9 and abs(r.kappa - (observed - expected) / (1 - expected)) < 1e-9
