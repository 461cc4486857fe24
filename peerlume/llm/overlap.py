"""The same or nearly the same record on both sides of a split.

Records are canonicalised (case, punctuation, markup, white space), hashed, and the hashes of the
evaluation splits are joined with those of train. Nearly equal records are found among the
*different* canonical texts only: rows with equal hashes are one class, so exact copies never
multiply the comparisons.

Two texts are nearly equal if titles and abstracts, each for itself and both together, share at
least ``SIMILAR`` of their different words (Jaccard); two missing abstracts count as equal, one
missing abstract does not equal a present one. NULL and empty titles without an abstract say
nothing and match nothing. Repeated rows match like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlume.functions.keys import abstract_words, canonical_doi, comparable_words
from peerlume.llm.tokens import Lookup
from peerlume.session import materialised

SIMILAR = 0.64  # "about two thirds": slack for a word or two in short titles
SLACK = 1e-9  # rounding of products with SIMILAR never shortens a prefix or tightens a bound
FREQUENT_SHARE = 0.001  # title words in more of the records than this have their counts in the literal table
SKETCH = 4  # 64-bit words of the parity sketch of an abstract; a title has one
CELL = 2_000  # texts of one side that share a key and are compared in one task


def jaccard(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of different values; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def hashed(words: Column) -> Column:
    """Words as sorted 64-bit hashes, which are smaller and faster to compare."""
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def word_counts(df: DataFrame, title: Column) -> Lookup:
    """How many titles hold each word that is in more than FREQUENT_SHARE of them, as a literal table.

    Each title has each of its words once, so there are at most 1000 x (mean number of words) of
    them, however large the corpus is. Words that are not in it are rarer than those that are.
    """
    words = df.select(comparable_words(title).alias("w"))
    least = max(16, int(words.count() * FREQUENT_SHARE))
    counts = words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
    return Lookup({r.w: [min(r.n, 2**31 - 1)] for r in counts})


def prefix(words: Column, counts: Lookup) -> Column:
    """Hashes of the first words by frequency, so many that two texts of SIMILAR words share one.

    At a Jaccard of s, n words have s n in common with the other text at least, so of the first
    n - ceil(s n) + 1 in one order for all texts one is shared. The order (frequency, hash) only
    has to be the same for all texts; counts that lag behind the corpus cost time, never pairs.
    """
    ranked = counts.bind(lambda t: F.array_sort(F.transform(words, lambda w: F.struct(F.coalesce(t.first(w), F.lit(0)).alias("n"), F.xxhash64(w).alias("h")))))
    n = F.size(words)
    least = F.ceil(F.lit(SIMILAR) * n - SLACK)
    return F.slice(F.transform(ranked, lambda x: x["h"]), F.lit(1), F.when(n > 0, n - least + 1).otherwise(0).cast("int"))


def match_keys(title_words: str, abstract_words_: str, counts: Lookup) -> Column:
    """Keys of which two nearly equal texts share one: the prefix of the title, without title words that of the abstract."""
    return F.when(F.size(title_words) > 0, prefix(F.col(title_words), counts)).otherwise(prefix(F.col(abstract_words_), counts))


def parity(words: Column, size: int) -> list[Column]:
    """``size`` 64-bit words whose bits are the parities of so many buckets of word hashes.

    A bit in which two sketches differ takes a word that only one text has, another one for each
    bit, so the number of such bits never exceeds the number of differing words.
    """
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w, F.lit(64)).cast("int"))
    of = lambda w: F.pmod(F.shiftright(w, 8), F.lit(size))
    part = lambda i: F.aggregate(words, F.lit(0).cast("bigint"), lambda x, w: F.when(of(w) == i, x.bitwiseXOR(bit(w))).otherwise(x))
    return [part(i) for i in range(size)]


def sketch(t: str, a: str) -> Column:
    """Sizes and parity sketches of a text of word hashes, for :func:`may_match`."""
    sketches = [*parity(F.col(t), 1), *parity(F.col(a), SKETCH)]
    return F.struct(F.size(t).cast("short").alias("nt"), F.size(a).cast("short").alias("na"), *[x.alias(f"s{i}") for i, x in enumerate(sketches)])


def differing(x: Column, y: Column) -> tuple[Column, Column]:
    """Least numbers of words in which the titles and the abstracts of two sketched texts differ."""
    bits = [F.bit_count(x[f"s{i}"].bitwiseXOR(y[f"s{i}"])) for i in range(1 + SKETCH)]
    return bits[0], sum(bits[2:], bits[1])


def may_match(x: Column, y: Column) -> Column:
    """False only for two sketched texts that are not nearly equal: texts of m and n words with a
    Jaccard of s differ in (m + n) (1 - s) / (1 + s) words at most."""
    share = (1 - SIMILAR) / (1 + SIMILAR)
    titles, abstracts = differing(x, y)
    return (titles <= (x["nt"] + y["nt"]) * F.lit(share) + SLACK) & (abstracts <= (x["na"] + y["na"]) * F.lit(share) + SLACK)


def text_classes(df: DataFrame, record: Column, title: Column, abstract: Column, counts: Lookup) -> DataFrame:
    """(record_no, class_id, t, a, ks): class_id hashes the canonical title and abstract, t and a
    are word hashes, ks the keys of the text.

    Records with neither title nor abstract words have a NULL class.
    """
    out = df.select(record.alias("record_no"), comparable_words(title).alias("tw"), abstract_words(abstract).alias("aw"))
    text = F.concat_ws("|", F.array_join("tw", " "), F.array_join("aw", " "))
    class_id = F.when((F.size("tw") > 0) | (F.size("aw") > 0), F.md5(text))
    return out.select("record_no", class_id.alias("class_id"), hashed(F.col("tw")).alias("t"), hashed(F.col("aw")).alias("a"), match_keys("tw", "aw", counts).alias("ks"))


def near_classes(classes: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs (one, other) of different classes that are nearly equal; the flags ``left`` and ``right`` tell the sides.

    Exact: every pair that meets the criterion shares a key of its titles (see :func:`prefix`) and
    passes the sketches, which drop no such pair; what is left is compared word by word. A key
    that many texts share is cut into a grid of cells, each of CELL texts a side at most on
    average, so that no task holds all its comparisons. A pair is met once, at its first common key.
    """
    keyed = classes.select("class_id", left, right, "ks", sketch("t", "a").alias("k")).withColumn("key", F.explode("ks"))
    sides = keyed.groupBy("key").agg(F.count_if(left).alias("nl"), F.count_if(right).alias("nr")).where("nl > 0 and nr > 0")
    grid = sides.select("key", F.ceil(F.col("nl") / CELL).cast("int").alias("rows"), F.ceil(F.col("nr") / CELL).cast("int").alias("cols"))
    keyed = keyed.join(grid, "key")
    place = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = keyed.where(left).select("key", place("rows").alias("row"), every("cols").alias("col"), F.col("class_id").alias("one"), F.col("k").alias("k1"), F.col("ks").alias("ks1"))
    r = keyed.where(right).select("key", every("rows").alias("row"), place("cols").alias("col"), F.col("class_id").alias("other"), F.col("k").alias("k2"), F.col("ks").alias("ks2"))
    first = F.array_intersect("ks1", "ks2")[0] == F.col("key")
    pairs = l.join(r, ["key", "row", "col"]).where((F.col("one") != F.col("other")) & may_match(F.col("k1"), F.col("k2")) & first).select("one", "other")
    content = classes.select("class_id", "t", "a")
    full = pairs.join(content.withColumnsRenamed({"class_id": "one", "t": "t1", "a": "a1"}), "one").join(
        content.withColumnsRenamed({"class_id": "other", "t": "t2", "a": "a2"}), "other"
    )
    return full.where(similar("t1", "a1", "t2", "a2")).select("one", "other")


def similar(t1: str, a1: str, t2: str, a2: str) -> Column:
    """Whether titles, abstracts and both together are nearly equal."""
    both = jaccard(F.array_union(t1, a1), F.array_union(t2, a2))
    return (jaccard(t1, t2) >= SIMILAR) & (jaccard(a1, a2) >= SIMILAR) & (both >= SIMILAR)


def linked_classes(df: DataFrame, train: str, evaluation: tuple[str, ...], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Members (entry_no, side, doi, class_id, keep...) of the two sides, and links (one, other) from
    the classes of train to those of evaluation with the same or nearly the same text. Records
    without title and abstract words have a NULL class."""
    side = F.when(F.col("split") == train, F.lit("t")).when(F.col("split").isin(*evaluation), F.lit("e"))
    rows = df.select("entry_no", side.alias("side"), canonical_doi(F.col("doi")).alias("doi"), "title", "abstract", *keep).where("side is not null")
    counts = word_counts(rows, F.col("title"))
    record = F.struct("entry_no", "side", "doi", *keep)
    texts = materialised(text_classes(rows, record, F.col("title"), F.col("abstract"), counts).select("record_no.*", "class_id", "t", "a", "ks"), "overlap-texts")
    classes = materialised(
        texts.where("class_id is not null").groupBy("class_id").agg(
            F.any_value("t").alias("t"), F.any_value("a").alias("a"), F.any_value("ks").alias("ks"),
            F.max(F.col("side") == "t").alias("has_train"), F.max(F.col("side") == "e").alias("has_eval"),
        ),
        "overlap-classes",
    )
    same = classes.where("has_train and has_eval").select(F.col("class_id").alias("one"), F.col("class_id").alias("other"))
    return texts.drop("t", "a", "ks"), same.unionByName(near_classes(classes, "has_train", "has_eval"))


def overlaps(df: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(train_no, eval_no): all overlaps of articles-like rows (entry_no, doi, title, abstract, split)."""
    members, links = linked_classes(df, train, evaluation)
    t = members.where("side = 't'").select(F.col("entry_no").alias("train_no"), "doi", "class_id")
    e = members.where("side = 'e'").select(F.col("entry_no").alias("eval_no"), "doi", "class_id")
    by_doi = t.drop("class_id").where("doi is not null").join(e.drop("class_id").where("doi is not null"), "doi").select("train_no", "eval_no")
    by_text = (
        links.join(t.select(F.col("class_id").alias("one"), "train_no"), "one")
        .join(e.select(F.col("class_id").alias("other"), "eval_no"), "other")
        .select("train_no", "eval_no")
    )
    return by_doi.union(by_text).distinct()


def overlap_report(df: DataFrame, by: tuple[str, ...], train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(by..., eval_rows, overlapping_rows, overlapping_pairs) of the evaluation rows, per group of ``by``.

    No pair of rows is ever made: rows of equal DOI, text and group are one cell with a count. The
    train rows that overlap with a cell are those of its DOI and those of the classes linked with
    its class, less those that are both.
    """
    members, links = linked_classes(df, train, evaluation, keep=by)
    cells = materialised(members.groupBy("side", "doi", "class_id", *by).agg(F.count(F.lit(1)).alias("n")), "overlap-cells")
    links = materialised(links, "overlap-links")
    t = materialised(cells.where("side = 't'").groupBy("doi", "class_id").agg(F.sum("n").alias("n")), "overlap-train-cells")
    of_doi = t.where("doi is not null").groupBy("doi").agg(F.sum("n").alias("same_doi"))
    of_class = t.where("class_id is not null").groupBy(F.col("class_id").alias("one")).agg(F.sum("n").alias("n"))
    of_class = links.join(of_class, "one").groupBy(F.col("other").alias("class_id")).agg(F.sum("n").alias("same_text"))
    both = cells.where("side = 'e' and doi is not null").select("doi", F.col("class_id").alias("other")).distinct().join(links, "other")
    both = both.join(t.select("doi", F.col("class_id").alias("one"), "n"), ["doi", "one"])
    both = both.groupBy("doi", F.col("other").alias("class_id")).agg(F.sum("n").alias("same_both"))
    e = cells.where("side = 'e'").join(of_doi, "doi", "left").join(of_class, "class_id", "left").join(both, ["doi", "class_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    e = e.withColumn("pairs", zero("same_doi") + zero("same_text") - zero("same_both"))
    return e.groupBy(*by).agg(
        F.sum("n").alias("eval_rows"), F.sum(F.when(F.col("pairs") > 0, F.col("n")).otherwise(0)).alias("overlapping_rows"), F.sum(F.col("pairs") * F.col("n")).alias("overlapping_pairs")
    )
