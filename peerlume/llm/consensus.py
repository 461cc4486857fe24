"""Consensus from several annotators' labels.

Confusion matrices per annotator and label posteriors per item are estimated in turn
(expectation-maximisation, smoothed counts); agreement corrected for chance is reported apart.

The answers are gathered once into one row per item. A round of the estimation is one pass over
these rows in which each task makes the posteriors of its items and adds them up into the next
confusion matrices, so nothing but sums (annotators x classes x classes) leaves a task and no vote
is ever shuffled again. The matrices travel as a broadcast of checked size; beyond
``MOST_ANNOTATORS`` the same rounds run as joins.

Defined results: an annotator's latest answer on an item counts (ties: the highest answer
number); NULL, blank and unknown labels are no vote, nor are answers without an item or an
annotator; an item none of whose latest answers holds a label falls back on the earlier answers,
and without any label on the most frequent class of the field; an empty table gives an empty
result; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlume.functions.keys import once
from peerlume.session import cut, materialised

SMOOTHING = 1.0  # pseudo-counts of an annotator's row of the confusion matrix, spread as in the pooled matrix
ROUNDS = 50  # at most; the estimation ends when no entry of a confusion matrix moves by more than STILL
STILL = 0.005
MOST_ANNOTATORS = 20_000  # with nine classes the matrices of so many annotators take about 20 MB


@dataclass
class Answers:
    """One row (item, votes) per item, ``votes`` being the array of (annotator, x0, x1, ...) with xk
    the class of the k-th field or -1. An annotator votes once on an item, so a row never holds more
    than one vote per annotator."""

    rows: DataFrame
    classes: dict[str, list[str]]

    def votes(self) -> DataFrame:
        """(item, field, annotator, label, obs) of all votes."""
        each = self.rows.select("item", F.explode("votes").alias("v"))
        per = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v.x{k}").alias("obs")) for k, f in enumerate(self.classes)])
        out = each.select("item", F.col("v.annotator").alias("annotator"), F.explode(per).alias("y")).where("y.obs >= 0")
        return out.select("item", "y.field", "annotator", F.get(_names(self.classes)[F.col("y.field")], F.col("y.obs")).alias("label"), "y.obs")


def _names(classes: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for f, cs in classes.items() for x in (F.lit(f), F.array(*[F.lit(c) for c in cs]))])


def gather_answers(labels: DataFrame, item: str, annotator: str, order: list[str], fields: dict[str, Column], classes: dict[str, list[str]]) -> Answers:
    """The answers that count, one row per item, written once.

    ``fields`` are the labels in canonical spelling. The first aggregation combines on the map side
    by (item, annotator), so an annotator or an item with a third of all rows is no hot key; what is
    gathered per item is one answer per annotator.
    """
    place = F.struct(*order)
    raw = F.struct(*[F.col(f) for f in fields])
    # whether a label says anything is told without bringing it into its canonical spelling
    told = {f: F.translate(F.col(f), " _-\t\r\n\x0b\x0c\xa0", "") != "" for f in fields}
    last = labels.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(
        F.max_by(raw, place).alias("last"), *[F.max_by(F.col(f), F.when(told[f], place)).alias(f"any_{f}") for f in fields]
    )
    index = lambda f, c: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in classes[f]]), c) - 1, F.lit(-1)).cast("int")
    code = lambda f, spelled: once(spelled, lambda c: index(f, c))
    latest = last.select("item", "annotator", "last.*", *[f"any_{f}" for f in fields])
    latest = latest.select("item", "annotator", *[code(f, fields[f]).alias(f"x{k}") for k, f in enumerate(fields)], *[f"any_{f}" for f in fields])
    earlier = latest.select("item", "annotator", *[f"x{k}" for k in range(len(fields))], *[F.when(F.col(f"x{k}") < 0, F.col(f"any_{f}")).alias(f) for k, f in enumerate(fields)])
    coded = earlier.select("item", "annotator", *[f"x{k}" for k in range(len(fields))], *[F.when(F.col(f).isNull(), F.col(f"x{k}")).otherwise(code(f, fields[f])).alias(f"y{k}") for k, f in enumerate(fields)])
    gathered = coded.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("annotator", *[f"x{k}" for k in range(len(fields))], *[f"y{k}" for k in range(len(fields))]))).alias("v"),
        *[F.max(f"x{k}").alias(f"most{k}") for k in range(len(fields))],
    )
    pick = lambda v: F.struct(v["annotator"].alias("annotator"), *[F.when(F.col(f"most{k}") >= 0, v[f"x{k}"]).otherwise(v[f"y{k}"]).alias(f"x{k}") for k in range(len(fields))])
    return Answers(materialised(gathered.select("item", F.transform("v", pick).alias("votes")), "answers"), classes)


# --- the estimation in passes over the items -----------------------------------------------------


Model = tuple[np.ndarray, np.ndarray]  # log confusion matrices, shape (annotators, classes given, classes meant), and log class shares


def _posteriors(m: Model | None, k: int, a: np.ndarray, obs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(items, k) posteriors; the votes of item i begin at starts[i], and every item has one or more."""
    if m is None:  # shares of the votes
        one = np.zeros((len(obs), k))
        one[np.arange(len(obs)), obs] = 1.0
        total = np.add.reduceat(one, starts, axis=0)
        return total / total.sum(axis=1, keepdims=True)
    logs = np.add.reduceat(m[0][a, obs], starts, axis=0) + m[1]
    w = np.exp(logs - logs.max(axis=1, keepdims=True))
    return w / w.sum(axis=1, keepdims=True)


def _flat(batch: pa.RecordBatch, annotators: dict[str, int], field: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items with votes on a field: (row numbers, annotator, class given, start of each item)."""
    votes = batch.column(batch.schema.get_field_index("votes"))
    lengths = np.diff(votes.offsets.to_numpy())
    flat = votes.flatten()
    owner = np.repeat(np.arange(batch.num_rows), lengths)
    coded = flat.field(0).dictionary_encode()
    known = np.array([annotators[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
    a = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, dtype=np.int64)
    obs = flat.field(1 + field).to_numpy(zero_copy_only=False)
    given = obs >= 0
    owner, a, obs = owner[given], a[given], obs[given]
    rows, starts = np.unique(owner, return_index=True)
    return rows, a, obs, starts


def _sums(answers: Answers, annotators: dict[str, int], models: list[Model | None]) -> list[np.ndarray]:
    """Per field the sums of posteriors, shape (annotators, classes given, classes meant): one pass over the items."""
    sizes = [len(c) for c in answers.classes.values()]
    width = max(sizes)
    shared = answers.rows.sparkSession.sparkContext.broadcast((annotators, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now = shared.value
        sums = [np.zeros((len(names), k, k)) for k in sizes]
        for b in batches:
            for f, k in enumerate(sizes):
                rows, a, obs, starts = _flat(b, names, f)
                if len(rows):
                    post = _posteriors(now[f], k, a, obs, starts)
                    mine = np.repeat(post, np.diff(np.append(starts, len(obs))), axis=0)
                    at = a * k + obs
                    for j in range(k):
                        sums[f][:, :, j] += np.bincount(at, weights=mine[:, j], minlength=len(names) * k).reshape(len(names), k)
        for f, k in enumerate(sizes):
            a, obs = np.nonzero(sums[f].any(axis=2))
            cells = [pa.array(sums[f][a, obs, j]) if j < k else pa.nulls(len(a), pa.float64()) for j in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), f)), pa.array(a), pa.array(obs), *cells], names=["field", "a", "obs", *[f"s{j}" for j in range(width)]])

    cells = answers.rows.mapInArrow(run, "field bigint, a bigint, obs bigint, " + ", ".join(f"s{j} double" for j in range(width)))
    total = [np.zeros((len(annotators), k, k)) for k in sizes]
    for r in cells.groupBy("field", "a", "obs").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():  # at most MOST_ANNOTATORS x classes rows
        total[r.field][r.a, r.obs] = [r[f"s{j}"] for j in range(sizes[r.field])]
    shared.destroy()
    return total


def _model(n: np.ndarray) -> Model:
    """Smoothed confusion matrices and class shares from the sums of posteriors."""
    of_class = n.sum(axis=(0, 1))
    pooled = (n.sum(axis=0) + 0.1) / (of_class + 1.0)
    confusion = (n + SMOOTHING * pooled) / (n.sum(axis=1, keepdims=True) + SMOOTHING)
    return np.log(confusion), np.log((of_class + 0.5) / (of_class.sum() + 1.0))


@dataclass
class Consensus:
    """posteriors (item, field, p0, ...), confusion (field, annotator, obs, m0, ...) and how many rounds it took.

    ``reliability()`` gives (field, annotator, votes, reliability), the mean posterior of the labels
    an annotator gave; it takes one more pass.
    """

    posteriors: DataFrame
    confusion: DataFrame
    rounds: int
    reliability: Callable[[], DataFrame]


def reliability_em(answers: Answers, rounds: int = ROUNDS, most_annotators: int = MOST_ANNOTATORS) -> Consensus:
    """Expectation-maximisation until the confusion matrices stand still. Column j belongs to class j of the field."""
    spark, classes = answers.rows.sparkSession, answers.classes
    found = answers.rows.select(F.explode("votes.annotator").alias("a")).distinct().limit(most_annotators + 1).collect()
    if len(found) > most_annotators:
        return _by_joins(answers, rounds)
    names = sorted(r.a for r in found)
    annotators = {a: i for i, a in enumerate(names)}
    sizes, width = [len(c) for c in classes.values()], max(map(len, classes.values()))
    models: list[Model | None] = [None] * len(sizes)
    for done in range(1, rounds + 1):
        before, models = models, [_model(n) for n in _sums(answers, annotators, models)]
        if before[0] is not None and max((np.abs(np.exp(m[0]) - np.exp(b[0])).max(initial=0) for m, b in zip(models, before))) < STILL:
            break
    shared = spark.sparkContext.broadcast((annotators, models))
    fields = list(classes)
    kind = dict(answers.rows.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = shared.value
        for b in batches:
            items = b.column(b.schema.get_field_index("item"))
            for f, k in enumerate(sizes):
                rows, a, obs, starts = _flat(b, known, f)
                if len(rows):
                    post = _posteriors(now[f], k, a, obs, starts)
                    ps = [pa.array(post[:, j]) if j < k else pa.nulls(len(rows), pa.float64()) for j in range(width)]
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(rows)), pa.array([fields[f]] * len(rows)), *ps], names=["item", "field", *[f"p{j}" for j in range(width)]])

    posteriors = answers.rows.mapInArrow(run, f"item {kind}, field string, " + ", ".join(f"p{j} double" for j in range(width)))
    confusion = [
        (fields[f], names[a], o, *[float(x) for x in np.exp(m[0][a, o])], *[None] * (width - sizes[f]))
        for f, m in enumerate(models) if m is not None for a in range(len(names)) for o in range(sizes[f])
    ]

    def reliability() -> DataFrame:
        sums = _sums(answers, annotators, models) if names else []
        rows = [(fields[f], names[a], int(round(n[a].sum())), float(np.trace(n[a]) / n[a].sum())) for f, n in enumerate(sums) for a in range(len(names)) if n[a].sum() > 0]
        return spark.createDataFrame(rows, "field string, annotator string, votes bigint, reliability double")

    confusion = spark.createDataFrame(confusion, "field string, annotator string, obs int, " + ", ".join(f"m{j} double" for j in range(width)))
    return Consensus(posteriors, confusion, done, reliability)


# --- the same rounds as joins, for more annotators than a broadcast should carry ------------------


def _by_joins(answers: Answers, rounds: int) -> Consensus:
    """Votes stay partitioned by (item, field); a round shuffles them once, to the annotators' matrices."""
    spark, classes = answers.rows.sparkSession, answers.classes
    width = max(map(len, classes.values()))
    size = F.create_map(*[x for f, cs in classes.items() for x in (F.lit(f), F.lit(len(cs)))])
    votes = cut(answers.votes().select("item", "field", "annotator", "obs", size[F.col("field")].alias("k")).repartition("item", "field"))
    js = range(width)
    p = [F.col(f"p{j}") for j in js]
    post = votes.groupBy("item", "field").agg(F.first("k").alias("k"), *[F.avg((F.col("obs") == j).cast("double")).alias(f"p{j}") for j in js])
    confusion = None
    for done in range(1, rounds + 1):
        given = votes.join(post.drop("k"), ["item", "field"])
        sums = cut(given.groupBy("field", "annotator", "obs", "k").agg(*[F.sum(c).alias(f"n{j}") for j, c in zip(js, p)]))
        # annotators who never gave a class have a row for it too: its matrix entries are those of the pooled matrix
        pooled = sums.groupBy("field", "obs").agg(*[F.sum(f"n{j}").alias(f"a{j}") for j in js])
        of_field = pooled.groupBy("field").agg(*[F.sum(f"a{j}").alias(f"t{j}") for j in js])
        pooled = pooled.join(F.broadcast(of_field), "field").select("field", "obs", *[((F.col(f"a{j}") + 0.1) / (F.col(f"t{j}") + 1.0)).alias(f"q{j}") for j in js])
        of_annotator = sums.groupBy("field", "annotator").agg(*[F.sum(f"n{j}").alias(f"s{j}") for j in js])
        before = confusion
        share = lambda j: (F.col(f"n{j}") + SMOOTHING * F.col(f"q{j}")) / (F.col(f"s{j}") + SMOOTHING)
        confusion = cut(
            sums.join(of_annotator, ["field", "annotator"]).join(F.broadcast(pooled), ["field", "obs"])
            .select("field", "annotator", "obs", "k", *[F.when(F.lit(j) < F.col("k"), share(j)).alias(f"m{j}") for j in js])
        )
        total = reduce(lambda a, b: a + b, [F.coalesce(f"t{j}", F.lit(0.0)) for j in js])
        prior = of_field.select("field", *[F.log((F.col(f"t{j}") + 0.5) / (total + 1.0)).alias(f"l{j}") for j in js])
        # the join combines per (item, field) before anything else is shuffled; AQE splits a hot annotator
        logs = votes.join(confusion.drop("k"), ["field", "annotator", "obs"]).groupBy("item", "field").agg(F.first("k").alias("k"), *[F.sum(F.log(f"m{j}")).alias(f"e{j}") for j in js])
        logs = logs.join(F.broadcast(prior), "field").select("item", "field", "k", *[F.when(F.lit(j) < F.col("k"), F.col(f"e{j}") + F.col(f"l{j}")).alias(f"g{j}") for j in js])
        logs = logs.withColumn("top", F.greatest(*[F.col(f"g{j}") for j in js]) if width > 1 else F.col("g0"))
        logs = logs.select("item", "field", "k", *[F.exp(F.col(f"g{j}") - F.col("top")).alias(f"w{j}") for j in js])
        logs = logs.withColumn("norm", reduce(lambda a, b: a + b, [F.coalesce(f"w{j}", F.lit(0.0)) for j in js]))
        post = cut(logs.select("item", "field", "k", *[(F.col(f"w{j}") / F.col("norm")).alias(f"p{j}") for j in js]))
        if before is not None:
            old = before.select("field", "annotator", "obs", *[F.col(f"m{j}").alias(f"b{j}") for j in js])
            change = F.greatest(*[F.abs(F.col(f"m{j}") - F.col(f"b{j}")) for j in js]) if width > 1 else F.abs(F.col("m0") - F.col("b0"))
            if (confusion.join(old, ["field", "annotator", "obs"]).agg(F.max(change)).first()[0] or 0.0) < STILL:
                break
    own = F.get(F.array(*p), F.col("obs"))
    reliability = lambda: votes.join(post.drop("k"), ["item", "field"]).groupBy("field", "annotator").agg(F.count(F.lit(1)).alias("votes"), F.avg(own).alias("reliability"))
    return Consensus(post.drop("k"), confusion.drop("k"), done, reliability)


def best_label(post: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """(item, field, label, posterior); ties go to the class named first."""
    width = max(map(len, classes.values()))
    best = F.greatest(*[F.struct(F.round(f"p{j}", 9).alias("p"), F.lit(-j).alias("j")) for j in range(width)])
    return post.select("item", "field", once(best, lambda b: b).alias("b")).select("item", "field", F.get(_names(classes)[F.col("field")], -F.col("b.j")).alias("label"), F.col("b.p").alias("posterior"))


def agreement(answers: Answers) -> DataFrame:
    """(field, items, observed, expected, kappa): Fleiss' kappa for varying numbers of votes.

    observed is the mean share of agreeing pairs of votes over the items with two votes or more,
    expected the sum of the squared class shares of their votes; kappa is NULL where expected is 1.
    All of it is sums over the items' rows, combined on the map side.
    """
    width = max(map(len, answers.classes.values()))
    of = lambda k, j: F.size(F.filter("votes", lambda v: v[f"x{k}"] == j))
    tally = lambda k: F.array(*[of(k, j) for j in range(width)])
    per = answers.rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tally(k).alias("n")) for k, f in enumerate(answers.classes)])).alias("c")).select("c.*")
    per = per.select("field", "n", F.aggregate("n", F.lit(0), lambda a, x: a + x).cast("double").alias("m")).where("m > 1")
    same = F.aggregate("n", F.lit(0.0), lambda a, x: a + x * (x - 1))
    sums = per.groupBy("field").agg(
        F.count(F.lit(1)).alias("items"), F.avg(same / (F.col("m") * (F.col("m") - 1))).alias("observed"), F.sum("m").alias("all"),
        *[F.sum(F.get("n", F.lit(j))).alias(f"n{j}") for j in range(width)],
    )
    expected = reduce(lambda a, b: a + b, [(F.col(f"n{j}") / F.col("all")) ** 2 for j in range(width)])
    out = sums.select("field", "items", "observed", expected.alias("expected"))
    return out.select("field", "items", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))
