"""Keyword-stuffed and link-list pages.

One Arrow pass measures every text: the share of its words that stand in sentences, link share,
separator density, the share of its most frequent word and of repeated word pairs, short and
duplicate lines, and the share of function words in the language that fits best. The limits of all
these shares are calibrated per language from the corpus (medians over all its texts), never below
a floor; then a page is spam if less than half of it is prose and one sign of stuffing holds.

Defined results: NULL, empty and blank texts are no spam; copies of a spam page are spam; a text
with fewer than MIN_UNITS words, links included, is too short to tell; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_UNITS = 12
LINK_UNITS = 4  # a link weighs as much as so many words

# Frequent function words per language.
FUNCTION_WORDS = {
    "en": "the of and in to a is that was were for with we by on as are this it not from which have has been be or an at our their but "
    "after before than how more i would should rather who may can did will used no its been these",
    "de": "der die das und ist nicht den von zu mit des dem ein eine einer eines für auf im in als auch sie bitte dass wäre wären sich wurde "
    "wird weshalb gegen jedoch es bei nach aus",
    "fr": "le la les des et est une un pas que dans pour sur par il du de avec ne au aux ce cette qui l d n chez être mais à en son",
    "es": "el los las que no una es en del con por como la de y se al lo para un su tal está más sin aunque",
    "pt": "o os as que uma é não para da do em a de um no na com por ao dos das se são foi e mais sobre",
}
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_FUNCTION.values())
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"<[^<>]{0,300}>")
_WORD = re.compile(r"[^\W_]+")
_IDEOGRAPH = re.compile("[぀-ヿ一-鿿가-힯]")
_CHUNK = re.compile(r"(?<=[.!?])\s+|[\r\n]+|[。！？]|\s\|\s")
_SEPARATOR = re.compile(r"[,|;»#•·]|\s[-–—/]\s")
_LINE = re.compile(r"[\r\n]+")
_ANCHOR = re.compile(r"<a\s", re.I)
_FUNCTION_CHARACTER = re.compile("[的了是在和不没有请与但也而及はをがのにでともしる]")
_HEAVY = re.compile(r"[|»#•·]|\s[-–—/]\s")

FEATURES = (
    "n int, ideographs int, links int, prose int, function_share double, language string, top double, pairs double, "
    "kinds int, separators int, hashes int, short_lines double, lines int, same_lines double"
)
LEAST_TOP = 0.055  # no language has a lower limit for its top word
SAME_LINES = 0.5  # share of lines that repeat an earlier one, from which lines count as duplicated
LEAST_LINES = 4  # fewer lines are too few to tell
PROSE_SHARE = 0.15  # least share of function words in a sentence
# least limits of the signs: a language whose texts usually have more of something gets a higher one
FLOORS = {"separators": 0.25, "links": 0.3, "pairs": 0.25, "same_lines": SAME_LINES, "short_lines": 0.7}


def measure(text: str) -> tuple:
    """The features of one text, in the order of FEATURES.

    Prose and repeated pairs are counted only where some sign of spam is possible at all; elsewhere
    they cannot change the result.
    """
    links = len(_URL.findall(text)) + len(_ANCHOR.findall(text)) + text.count("](")
    plain = _TAG.sub(" ", _URL.sub(" ", text)) if links or "<" in text else text
    words = _WORD.findall(plain.lower())
    n = len(words)
    counts = Counter(words)
    ideographs = len(_IDEOGRAPH.findall(plain))
    if ideographs > n:
        language, share = "cjk", len(_FUNCTION_CHARACTER.findall(plain)) / ideographs
    else:
        shares = {k: sum(counts[w] for w in counts.keys() & s) / max(n, 1) for k, s in _FUNCTION.items()}
        language = max(shares, key=lambda k: shares[k])
        share = shares[language]
        language = language if share > 0 else "none"
    top = max((v for w, v in counts.items() if w not in _ANY), default=0) / max(n, 1)
    separators, hashes = len(_SEPARATOR.findall(plain)), plain.count("#")
    lines = [x for x in _LINE.split(plain) if x.strip()]
    short = sum(len(x.split()) <= 5 and x.rstrip()[-1:] not in ".!?" for x in lines) / max(len(lines), 1)
    same = 1 - len({x.strip().lower() for x in lines}) / max(len(lines), 1)
    duplicated = len(lines) >= LEAST_LINES and same >= SAME_LINES
    repeated = top >= LEAST_TOP or duplicated
    pairs = sum(v for v in Counter(zip(words, words[1:])).values() if v >= 3) / max(n, 1) if repeated else 0.0
    possible = links >= 5 or hashes >= 8 or separators >= max(12, 0.25 * n) or repeated or (len(lines) >= 12 and short >= 0.7)
    prose = _prose_words(plain, ideographs) if possible else n + ideographs
    return (n, ideographs, links, prose, share, language, top, pairs, len(counts), separators, hashes, short, len(lines), same)


def _prose_words(plain: str, ideographs: int) -> int:
    """Words and ideographs that stand in sentences: enough function words, few repeats, few separators."""
    prose = 0
    for chunk in _CHUNK.split(plain):
        if len(chunk) < 8:
            continue
        c = chunk.lower()
        k = len(_IDEOGRAPH.findall(c)) if ideographs else 0
        if k >= 6:
            ws = c.split()
            listed = len(ws) >= 6 and len(set(ws)) < 0.6 * len(ws)
            if not listed and len(_SEPARATOR.findall(c)) + c.count("、") <= k / 5 and len(_FUNCTION_CHARACTER.findall(c)) >= 0.03 * k:
                prose += k + len(_WORD.findall(c))
            continue
        ws = _WORD.findall(c)
        m = len(ws)
        kinds = set(ws)
        if m < 4 or (len(kinds) < 0.6 * m and m > 6):
            continue
        fits = max(sum(w in s for w in ws) for s in _FUNCTION.values())
        different = max(len(kinds & s) for s in _FUNCTION.values())
        if fits >= PROSE_SHARE * m and different >= min(2, m // 5 + 1) and len(_HEAVY.findall(c)) + 0.5 * c.count(",") <= m / 5:
            prose += m
    return prose


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, features...) of the texts that are not NULL or blank."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measure(t) for t in b[text]], columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    kind = dict(docs.dtypes)[key]
    return docs.where(F.col(text).rlike(r"\S")).select(key, text).mapInPandas(run, f"{key} {kind}, {FEATURES}")


def calibrate(measured: DataFrame) -> DataFrame:
    """Limits per language: half of the median share of function words; for the share of the top word
    one and a half medians, between LEAST_TOP and 0.12; for the shares of separators, links, repeated
    word pairs, duplicate and short lines so many medians of the language, its floor at least."""
    median = lambda c: F.percentile_approx(c, 0.5)
    units = F.greatest(F.lit(1), F.col("n") + F.col("ideographs") + LINK_UNITS * F.col("links"))
    above = lambda c, name, times=3.0: F.greatest(F.lit(FLOORS[name]), times * median(c)).alias(f"most_{name}")
    return measured.where("n + ideographs >= 20 and language <> 'none'").groupBy("language").agg(
        (0.5 * median("function_share")).alias("least_function"),
        F.greatest(F.lit(LEAST_TOP), F.least(F.lit(0.12), 1.5 * median("top"))).alias("most_top"),
        above(F.when(F.col("language") != "cjk", F.col("separators") / F.greatest(F.lit(1), F.col("n"))), "separators"),
        above(LINK_UNITS * F.col("links") / units, "links"), above("pairs", "pairs"), above("same_lines", "same_lines", 1.5), above("short_lines", "short_lines", 1.2),
    )


def spam_pages(measured: DataFrame) -> DataFrame:
    """Rows of ``measured`` that are spam, each with its signs."""
    limits = calibrate(measured)  # one row per language known to FUNCTION_WORDS, and two more
    df = measured.join(F.broadcast(limits), "language", "left")
    units = F.col("n") + F.col("ideographs") + LINK_UNITS * F.col("links")
    repeated = F.col("top") >= F.coalesce("most_top", F.lit(LEAST_TOP))
    stuffed = (F.col("n") >= F.when(F.col("language") == "cjk", 40).otherwise(60)) & (F.col("kinds") <= 45) & repeated
    prose = F.when(stuffed, F.lit(0.0)).otherwise(F.col("prose") / units)
    limit = {name: F.coalesce(f"most_{name}", F.lit(floor)) for name, floor in FLOORS.items()}
    duplicated = (F.col("lines") >= LEAST_LINES) & (F.col("same_lines") >= limit["same_lines"])
    few_function = F.col("function_share") < F.coalesce("least_function", F.lit(0.15))
    signs = F.array_compact(
        F.array(
            F.when((F.col("links") >= 5) & (F.col("links") * LINK_UNITS >= limit["links"] * units), F.lit("links")),
            F.when((F.col("hashes") >= 8) & (F.col("hashes") >= limit["separators"] * F.col("n")), F.lit("tags")),
            F.when((F.col("separators") >= 12) & (F.col("separators") >= limit["separators"] * F.col("n")) & (few_function | (F.col("n") - F.col("prose") >= 40)), F.lit("separators")),
            F.when((F.col("pairs") >= limit["pairs"]) & (repeated | duplicated) & (F.col("n") >= 40), F.lit("keywords")),
            F.when((F.col("lines") >= 12) & (F.col("short_lines") >= limit["short_lines"]) & (few_function | ((F.col("lines") >= 20) & (F.col("short_lines") >= 0.9))), F.lit("short lines")),
            F.when(duplicated & few_function, F.lit("duplicate lines")),
            F.when(stuffed, F.lit("few kinds")),
        )
    )
    out = df.withColumn("prose_share", prose).withColumn("signs", signs)
    return out.where((units >= MIN_UNITS) & (F.col("prose_share") < 0.5) & (F.size("signs") > 0))
