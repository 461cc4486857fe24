"""Deduplicating new batches against all history.

The history is kept as sorted runs. Every record gives exact keys (id, DOI, text hash) and the
prefix keys of its title (without a title, of its abstract), of which two nearly equal texts share
one at least (:func:`peerlume.llm.overlap.prefix`). Keys are uniform 64-bit hashes; a run is cut
into blocks of the key range, which are folders, and sorted inside a block by key and, among the
entries of one key, by a word of the abstract that nearly equal texts mostly have in common (a
min-wise order that differs from key to key).

A batch reads only the blocks that hold its keys and of these only the entries of its keys. It is
merged into them in that order and each new record compared with ``WINDOW`` neighbours on either
side. Whatever is not known by then is compared with all earlier entries of its keys, in cells of
bounded size, so the windows save time (the copies of a large family find one another there) and
lose nothing. Afterwards the batch is a run of its own; runs are merged with runs of their size now and
then, so an entry is rewritten about log(history) times and old runs are deleted.

Defined results: NULL, blank and stand-in ids, DOIs and texts name nothing; a record is known if an
earlier one (history, or a lower number in this or an earlier batch) has the same id, the same DOI
(version included) or a nearly equal title and abstract; repeated rows know each other; an empty
batch gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlume.functions.keys import abstract_words, canonical_doi, canonical_id, comparable_words
from peerlume.llm.overlap import SIMILAR, SKETCH, SLACK, hashed, match_keys, may_match, similar, sketch
from peerlume.llm.tokens import Lookup
from peerlume.session import Scratch, materialised, remove, shared_table_path

WINDOW = 4  # neighbours on either side in the first comparison
CELL = 20_000  # entries of one key that are compared with a new record in one task
BLOCK_ENTRIES = 250_000  # a block of the key range holds about so many entries of a run
MOST_BITS = 14  # the key range is cut into at most 2^14 blocks
MOST_KEYS = 1_000_000  # keys of a batch that are broadcast, 8 MB
COMPACT_AFTER = 3  # runs beyond the base run

BEFORE_ALL = -1  # sequence number of everything accepted before the first batch
TEXT = 2  # number of the exact kind that hashes the text; 0 is the id, 1 the DOI
SK = "sk struct<nt:smallint,na:smallint,s0:bigint,s1:bigint,s2:bigint,s3:bigint,s4:bigint>"
EXACT = "kind int, key bigint, seq bigint, block int"
NEAR = f"key bigint, ord bigint, seq bigint, rec bigint, {SK}, block int"
TEXTS = "rec bigint, seq bigint, t array<bigint>, a array<bigint>"


def records(df: DataFrame, counts: Lookup, number: str, seq: Column, id_col: str = "id", doi: str = "doi", title: str = "title", abstract: str = "abstract", keep: tuple[str, ...] = ()) -> DataFrame:
    """Comparable form of records: (rec, seq, id, doi, text, t, a, ks): id, doi and text are hashed
    exact keys or NULL, t and a the word hashes of title and abstract, ks the keys of the text."""
    out = df.select(
        *keep, F.col(number).alias("rec"), seq.cast("bigint").alias("seq"), canonical_id(F.col(id_col)).alias("id"), canonical_doi(F.col(doi)).alias("doi"),
        comparable_words(F.col(title)).alias("tw"), abstract_words(F.col(abstract)).alias("aw"),
    )
    key = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    text = F.when(F.size("tw") + F.size("aw") > 0, F.xxhash64(F.md5(F.concat_ws("|", F.array_join("tw", " "), F.array_join("aw", " ")))))
    return out.select(
        *keep, "rec", "seq", key(F.col("id")).alias("id"), key(F.col("doi")).alias("doi"), text.alias("text"), hashed(F.col("tw")).alias("t"), hashed(F.col("aw")).alias("a"),
        match_keys("tw", "aw", counts).alias("ks"),
    )


def exact_keys(recs: DataFrame) -> DataFrame:
    """(kind, key, seq, rec) of the exact keys that records have."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in enumerate(("id", "doi", "text"))])
    return recs.select("seq", "rec", F.explode(kinds).alias("k")).select("k.*", "seq", "rec").where("key is not null")


def near_entries(recs: DataFrame) -> DataFrame:
    """(key, ord, seq, rec, sk): an entry for each prefix key; ord is the first word hash of the abstract
    (without one, of the title) from the key on, round the end of the hash range."""
    words = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("t"))
    each = recs.where("text is not null").select("seq", "rec", sketch("t", "a").alias("sk"), words.alias("w"), "ks")
    # prefixes hold the smallest hashes, so they are hashed once more: blocks of the key range are even
    each = each.select("seq", "rec", "sk", "w", F.explode(F.transform("ks", lambda k: F.xxhash64(k))).alias("key"))  # beside a generator the struct would lose its names
    place = F.coalesce(F.get(F.filter("w", lambda x: x >= F.col("key")), F.lit(0)), F.get("w", F.lit(0)))
    return each.select("key", place.alias("ord"), "seq", "rec", "sk")


def neighbours(entries: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rec, other, other_seq): new records (``mine``) and the earlier ones within ``window`` places of
    the same key whose sketches allow that they match. Entries are cut into ranges of (key, ord), so a
    key with a third of all entries is many tasks."""
    share = (1 - SIMILAR) / (1 + SIMILAR)
    bits = [f"s{i}" for i in range(1 + SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        names = ["key", "seq", "rec", "mine", "nt", "na", *bits]
        for b in batches:
            now = pa.Table.from_batches([b])
            old = 0 if last is None else last.num_rows
            rows = now if last is None else pa.concat_tables([last, now])
            c = {n: rows.column(n).to_numpy() for n in names}
            out: list[tuple[np.ndarray, ...]] = []
            for d in range(1, window + 1):
                if rows.num_rows <= d:
                    break
                x, y = np.arange(rows.num_rows - d), np.arange(d, rows.num_rows)
                met = (c["key"][x] == c["key"][y]) & (y >= old) & (c["mine"][x] | c["mine"][y])
                x, y = x[met], y[met]
                apart = [np.bitwise_count(c[s][x] ^ c[s][y]).astype(np.int64) for s in bits]
                of = lambda n, x=x, y=y: (c[n][x].astype(np.int64) + c[n][y]) * share + SLACK
                near = (apart[0] <= of("nt")) & (sum(apart[1:]) <= of("na"))
                x, y = x[near], y[near]
                for new, other in ((x, y), (y, x)):
                    ok = c["mine"][new] & (c["seq"][other] < c["seq"][new])
                    out.append((c["rec"][new][ok], c["rec"][other][ok], c["seq"][other][ok]))
            last = rows.slice(max(0, rows.num_rows - window))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["rec", "other", "other_seq"])

    flat = entries.select("key", "ord", "seq", "rec", "mine", "sk.*")
    ordered = flat.repartitionByRange("key", "ord").sortWithinPartitions("key", "ord", "seq", "rec")
    return ordered.mapInArrow(run, "rec bigint, other bigint, other_seq bigint").distinct()


@dataclass
class Run:
    """A written run: its entries by key block, its texts, and how many records it holds."""

    exact: str
    near: str
    texts: list[str]
    records: int


@dataclass
class History:
    """Persisted runs, the oldest (and largest) first."""

    spark: SparkSession
    path: str | None = None
    runs: list[Run] = field(default_factory=list)
    bits: int = 0
    written: int = 0

    def __post_init__(self) -> None:
        self.path = self.path or shared_table_path(self.spark, "history")

    def _fresh(self, kind: str) -> str:
        self.written += 1
        return f"{self.path}/{kind}-{self.written}"

    def _read(self, paths: list[str], schema: str, blocks: list[int] | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = reduce(lambda a, b: a.unionByName(b), [self.spark.read.schema(schema).parquet(p) for p in paths])
        return out if blocks is None else out.where(F.col("block").isin(blocks))

    def _block(self, key: Column) -> Column:
        return F.shiftrightunsigned(key, 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def _write(self, df: DataFrame, kind: str, order: list[str]) -> str:
        """Sorted, by block; tasks are balanced at run time, so a hot key is more than one file of its block."""
        path = self._fresh(kind)
        df.withColumn("block", self._block(F.col("key"))).hint("rebalance", "block").sortWithinPartitions("block", *order).write.partitionBy("block").parquet(path)
        return path

    def contents(self) -> DataFrame:
        return self._read([p for r in self.runs for p in r.texts], TEXTS)

    def _keep(self, recs: DataFrame) -> tuple[DataFrame, str, int]:
        """Write records, which are the texts of their run."""
        path = self._fresh("texts")
        recs.write.parquet(path)
        kept = self.spark.read.schema(recs.schema).parquet(path)
        return kept, path, kept.count()

    def add(self, recs: DataFrame) -> None:
        """Accept records without checking them. Of equal texts the earliest gets entries, so a text
        that a third of all records share is one entry a key."""
        kept, texts, n = self._keep(recs)
        if not self.runs:
            self.bits = min(MOST_BITS, max(0, -(-8 * n // BLOCK_ENTRIES) - 1).bit_length())
        first = kept.where("text is not null").groupBy("text").agg(F.min(F.struct("seq", "rec")).alias("f")).select("f.*")
        near = near_entries(kept.join(first, ["seq", "rec"], "left_semi"))
        exact = exact_keys(kept).groupBy("kind", "key").agg(F.min("seq").alias("seq"))
        self.runs.append(Run(self._write(exact, "exact", ["kind", "key"]), self._write(near, "near", ["key", "ord"]), [texts], n))

    def _blocks(self, df: DataFrame) -> list[int] | None:
        """Blocks of the keys of ``df``: at most 2^MOST_BITS numbers."""
        return [r.b for r in df.select(self._block(F.col("key")).alias("b")).distinct().collect()] if self.bits else None

    def check(self, recs: DataFrame) -> DataFrame:
        """(rec) of the records that are known; the batch is a run of the history afterwards."""
        scratch = Scratch(self.spark)
        old = list(self.runs)
        kept, texts, n = self._keep(recs)
        own = exact_keys(kept)
        exact = scratch.table(own.groupBy("kind", "key").agg(F.min("seq").alias("seq")), "batch-keys")
        held = self._read([r.exact for r in old], EXACT, self._blocks(exact)).select("kind", "key", "seq").unionByName(exact)
        # a key has one entry a run, so nothing multiplies here
        matched = own.join(held.withColumnRenamed("seq", "held"), ["kind", "key"]).where("held < seq").select("rec", "kind").distinct()
        matched = scratch.table(matched, "known-exactly")
        known = matched.select("rec").distinct()

        # records whose very text is known need no entries of their own
        near = near_entries(kept.join(matched.where(F.col("kind") == TEXT), "rec", "left_anti"))
        run = Run(self._write(exact, "exact", ["kind", "key"]), self._write(near, "near", ["key", "ord"]), [texts], n)
        self.runs.append(run)
        new = self._read([run.near], NEAR).drop("block").join(known.withColumn("k", F.lit(True)), "rec", "left").withColumn("mine", F.col("k").isNull()).drop("k")
        keys = new.where("mine").select("key").distinct()
        few = self._read([run.near], NEAR).count() <= MOST_KEYS
        past = self._read([r.near for r in old], NEAR, self._blocks(keys)).drop("block").withColumn("mine", F.lit(False))
        # the keys of a batch of common size go to the history's blocks, not the blocks to the keys
        touched = scratch.table(past.unionByName(new).join(F.broadcast(keys) if few else keys, "key", "left_semi"), "touched")

        words = kept.select("rec", F.col("t").alias("t1"), F.col("a").alias("a1"))
        content = self.contents().select(F.col("rec").alias("other"), F.col("seq").alias("other_seq"), F.col("t").alias("t2"), F.col("a").alias("a2"))
        same = lambda p: p.join(words, "rec").join(content, ["other", "other_seq"]).where(similar("t1", "a1", "t2", "a2")).select("rec").distinct()
        beside = scratch.table(same(neighbours(touched)), "known-nearly")
        out = materialised(known.unionByName(beside).unionByName(same(self._crowded(touched, beside))).distinct(), "known")
        scratch.drop()
        self.compact()
        return out

    def _crowded(self, touched: DataFrame, beside: DataFrame) -> DataFrame:
        """(rec, other, other_seq) of new records that no neighbour knew, with all earlier entries of their keys."""
        # keys of more than CELL entries, of which there are at most entries / CELL
        parts = touched.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
        split = lambda df: df.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = split(touched.where("mine").join(beside, "rec", "left_anti"))
        mine = mine.select("key", "seq", "rec", F.col("sk").alias("k1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        others = split(touched).select("key", F.col("seq").alias("other_seq"), F.col("rec").alias("other"), F.col("sk").alias("k2"), F.pmod(F.xxhash64("rec", "seq"), "parts").cast("int").alias("part"))
        return mine.join(others, ["key", "part"]).where((F.col("other_seq") < F.col("seq")) & may_match(F.col("k1"), F.col("k2"))).select("rec", "other", "other_seq").distinct()

    def compact(self) -> None:
        """Merge the runs behind the base into one, and that with a base of no more than twice its size."""
        if len(self.runs) <= COMPACT_AFTER + 1:
            return
        at = 1 if self.runs[0].records > 2 * sum(r.records for r in self.runs[1:]) else 0
        merged = self.runs[at:]
        n = sum(r.records for r in merged)
        old_bits = self.bits
        if at == 0:
            self.bits = min(MOST_BITS, max(0, -(-8 * n // BLOCK_ENTRIES) - 1).bit_length())
        assert at == 0 or self.bits == old_bits
        exact = self._read([r.exact for r in merged], EXACT).groupBy("kind", "key").agg(F.min("seq").alias("seq"))
        near = self._read([r.near for r in merged], NEAR).drop("block")
        texts = self._fresh("texts")
        self._read([p for r in merged for p in r.texts], TEXTS).write.parquet(texts)
        self.runs[at:] = [Run(self._write(exact, "exact", ["kind", "key"]), self._write(near, "near", ["key", "ord"]), [texts], n)]
        for p in [p for r in merged for p in (r.exact, r.near, *r.texts)]:
            remove(self.spark, p)


def found_in_batches(history: History, recs: DataFrame, batch: str, batches: list[int]) -> DataFrame:
    """(rec) of all batches' records that are known, batch after batch; each is part of the history when checked."""
    out = recs.select("rec").where(F.lit(False))
    for b in batches:
        out = out.unionByName(history.check(recs.where(F.col(batch).eqNullSafe(F.lit(b))).drop(batch)))
    return out
