"""Encoding of a corpus with the public byte-level BPE vocabularies.

Texts are cut into words by the vocabulary's pattern; the *distinct* words of the corpus are
merged once each (Spark higher-order functions fold the ranked merges over the bytes of a word,
ranks and ids come from literal tables), and every text is then looked up word by word. Bytes
are written as hexadecimal digits, so a piece is a string and joining strings joins pieces.

The literal tables are two-choice hash tables: a key lies in one of two slots, so a look-up is
two comparisons at most, where a literal map would be searched from end to end.

Defined results: NULL and empty texts have no ids (an empty list); special tokens are ordinary
text; repeated texts are encoded like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlume.functions.keys import once
from peerlume.session import materialised

DEFAULT_FOLDER = "/opt/tokenizers"

# Fixed value: how the vocabulary cuts texts into words, with Unicode white space spelled out for Java.
_SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+)"

_SEPARATOR = "\x01x\x01"  # no word holds it: a word with a letter holds no control character
LITERAL_WORDS = 100_000  # the most frequent words of the corpus; the rest is looked up by a join
LONGEST_FOLD = 384  # bytes; the fold is quadratic, so longer words go to the vocabulary's own merge routine


def read_ranks(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> dict[bytes, int]:
    """Byte pieces and their ranks, which are their ids."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Lookup:
    """A two-choice hash table of string keys with integer lists, as one Spark literal.

    :meth:`bind` puts the literal into an expression once and hands its parts to the caller, so
    that neither the plan nor a task carries it twice.
    """

    def __init__(self, entries: dict[str, list[int]]):
        import xxhash

        names = list(entries)
        hashes = [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(w.encode(), seed=42) for w in names)]
        slots = max(16, int(len(names) * 2.6))
        for slots in range(slots, slots + 64):
            at = _place([(h % slots, (h >> _SHIFT) % slots) for h in hashes])
            if at is not None:
                break
        else:
            raise RuntimeError("the look-up table could not be built")
        self.slots = slots
        keys, offsets, lengths, values = [""] * slots, [0] * slots, [0] * slots, []
        for slot, k in at.items():
            keys[slot], offsets[slot], lengths[slot] = names[k], len(values), len(entries[names[k]])
            values += entries[names[k]]
        numbers = lambda x: F.split(F.lit(",".join(map(str, x or [0]))), ",").cast("array<int>")
        self.literal = F.struct(
            F.split(F.lit(_SEPARATOR.join(keys)), _SEPARATOR, -1).alias("keys"),
            numbers(offsets).alias("offsets"), numbers(lengths).alias("lengths"), numbers(values).alias("values"),
        )

    def bind(self, body) -> Column:
        """body(table) with the parts of the literal bound to a variable."""
        return F.transform(F.array(self.literal), lambda t: body(Bound(t, self.slots)))[0]


_SHIFT = 23


class Bound:
    """The table inside an expression."""

    def __init__(self, t: Column, slots: int):
        self.keys, self.offsets, self.lengths, self.values, self.slots = t["keys"], t["offsets"], t["lengths"], t["values"], slots

    def slot(self, word: Column) -> Column:
        """Slot of a word, -1 where it is not in the table."""
        a = F.pmod(F.xxhash64(word), F.lit(self.slots)).cast("int")
        b = F.pmod(F.shiftright(F.xxhash64(word), _SHIFT), F.lit(self.slots)).cast("int")
        return F.when(F.get(self.keys, a) == word, a).when(F.get(self.keys, b) == word, b).otherwise(F.lit(-1))

    def ids(self, slot: Column) -> Column:
        """The list in a slot; most words are one id, for which a slice would cost more than a new array."""
        whole = F.slice(self.values, F.get(self.offsets, slot) + 1, F.get(self.lengths, slot))
        return F.when(F.get(self.lengths, slot) == 1, F.array(F.get(self.values, F.get(self.offsets, slot)))).otherwise(whole)

    def first(self, word: Column) -> Column:
        """First number of a word's list, NULL where it is not in the table."""
        return F.get(self.values, F.get(self.offsets, self.slot(word)))


def _place(two: list[tuple[int, int]]) -> dict[int, int] | None:
    """Cuckoo placement: slot -> entry, or None if it does not come out. The first entries, which are
    the most frequent ones, are placed last and so mostly lie where a look-up looks first."""
    at: dict[int, int] = {}
    for k in reversed(range(len(two))):
        slot, moved = two[k][0], k
        for _ in range(500):
            if slot not in at:
                at[slot] = moved
                break
            at[slot], moved = moved, at[slot]
            a, b = two[moved]
            slot = b if slot == a else a
        else:
            return None
    return at


def words_of(text: Column) -> Column:
    """Words of a text in order; an empty array for NULL and empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(1))


def fold_merges(word_hex: Column, ranks: Lookup) -> Column:
    """Ids of a word given as hexadecimal digits: merge the leftmost pair of lowest rank until none has one."""
    none = F.lit(2**31 - 1)

    def fold(table: Bound) -> Column:
        def step(p: Column, _: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.coalesce(table.first(F.concat(F.get(p, i), F.get(p, i + 1))), none))
            # the pair ranks, then the best of them, are bound once by one-element transforms
            best = F.transform(F.array(pairs), lambda r: F.struct(F.array_min(r).alias("rank"), F.array_position(r, F.array_min(r)).cast("int").alias("at")))
            joined = lambda b: F.concat(
                F.slice(p, F.lit(1), b["at"] - 1), F.array(F.concat(F.get(p, b["at"] - 1), F.get(p, b["at"]))), F.slice(p, b["at"] + 2, F.size(p))
            )
            return F.when(F.size(p) < 2, p).otherwise(F.transform(best, lambda b: F.when(b["rank"] == none, p).otherwise(joined(b)))[0])

        bytes_ = F.regexp_extract_all(word_hex, F.lit("(..)"), F.lit(1))
        merged = F.aggregate(F.sequence(F.lit(1), (F.length(word_hex) / 2).cast("int")), bytes_, step)
        whole = table.first(word_hex)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, lambda x: table.first(x)))

    return ranks.bind(fold)


def word_ids(words: DataFrame, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(word, n) of distinct words -> (word, n, ids)."""
    ranks = Lookup({piece.hex().upper(): [rank] for piece, rank in read_ranks(name, folder).items()})
    coded = words.withColumn("code", F.hex(F.encode("word", "UTF-8")))
    short = F.length("code") <= 2 * LONGEST_FOLD
    folded = coded.where(short).select("word", "n", fold_merges(F.col("code"), ranks).alias("ids"))

    shared = words.sparkSession.sparkContext.broadcast(read_ranks(name, folder))  # executors need no vocabulary file

    @F.pandas_udf("array<int>")
    def long_word(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        for ws in batches:
            yield ws.map(enc.encode_ordinary)

    return folded.unionByName(coded.where(~short).select("word", "n", long_word("word").alias("ids")))


@dataclass
class Encoder:
    """Everything needed to encode texts: the literal table and the written dictionary."""

    lookup: Lookup
    dictionary: DataFrame
    complete: bool

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, literal_words: int = LITERAL_WORDS) -> Encoder:
        """Merge all distinct words of the corpus once and keep them in a written dictionary.

        Counting words combines on the map side; only distinct words are shuffled. The literal
        table holds the ``literal_words`` most frequent ones, a fixed bound.
        """
        words = texts.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        dictionary = materialised(word_ids(materialised(words, "words"), name, folder), "dictionary")
        top = dictionary.orderBy(F.desc("n"), "word").limit(literal_words + 1).select("word", "ids").collect()
        return cls(Lookup({r.word: r.ids for r in top[:literal_words]}), dictionary, len(top) <= literal_words)

    def _looked_up(self, docs: DataFrame, key: str, text: str, keep: tuple[str, ...], whole, combine, value, out: str) -> DataFrame:
        slot = lambda t: F.transform("_w", lambda w: t.slot(w))
        if self.complete:
            return docs.select(key, *keep, words_of(F.col(text)).alias("_w")).select(key, *keep, self.lookup.bind(lambda t: whole(t, slot(t))).alias(out))
        # words beyond the literal table are joined with the dictionary once per different text, then
        # go back to its rows by the text's hash: repeated texts and keys, and NULL keys, are no matter
        hashed = docs.select(key, *keep, text, F.md5(text).alias("_h"))
        words = hashed.select("_h", F.array_distinct(words_of(F.col(text))).alias("_w"))
        rare = words.select("_h", self.lookup.bind(lambda t: F.array_sort(F.filter("_w", lambda w: t.slot(w) < 0))).alias("_r")).where("size(_r) > 0")
        lists = rare.groupBy("_h").agg(F.any_value("_r").alias("_r")).select("_h", F.explode("_r").alias("word"))
        mine = lists.join(self.dictionary.select("word", "ids"), "word").groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("word", "ids"))).alias("_m"))
        mine = materialised(mine.select("_h", F.transform("_m", lambda x: x["word"]).alias("_r"), F.transform("_m", lambda x: x["ids"]).alias("_m")), "rare-words")
        both = hashed.join(mine, "_h", "left").select(key, *keep, words_of(F.col(text)).alias("_w"), "_r", "_m")
        own = lambda w: F.get("_m", F.array_position("_r", w).cast("int") - 1)
        mixed = self.lookup.bind(lambda t: combine(F.transform("_w", lambda w: once(t.slot(w), lambda s: value(t, s, own(w))))))
        return both.select(key, *keep, mixed.alias(out))

    def encode(self, docs: DataFrame, key: str, text: str = "text", out: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
        """(key, keep..., out): the ids of each text, one row per row of ``docs``."""
        return self._looked_up(
            docs, key, text, keep,
            whole=lambda t, s: F.flatten(F.transform(s, lambda x: t.ids(x))),
            combine=F.flatten,
            value=lambda t, s, own: F.when(s >= 0, t.ids(s)).otherwise(own),
            out=out,
        )

    def lengths(self, docs: DataFrame, key: str, text: str = "text", out: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
        """(key, keep..., out): the number of ids of each text, one row per row of ``docs``."""
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
        return self._looked_up(
            docs, key, text, keep,
            whole=lambda t, s: F.aggregate(s, F.lit(0), lambda a, x: a + F.get(t.lengths, x)),
            combine=total,
            value=lambda t, s, own: F.when(s >= 0, F.get(t.lengths, s)).otherwise(F.size(own)),
            out=out,
        )


def decode(ids: Column, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> Column:
    """Text of a list of ids: the binary pieces are joined, then read as UTF-8."""
    ranks = read_ranks(name, folder)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    literal = F.split(F.lit(",".join(pieces)), ",", -1)
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "")), "UTF-8")


def plain_pattern() -> re.Pattern:
    """The word pattern for tests in Python."""
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
