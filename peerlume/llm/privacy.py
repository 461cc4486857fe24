"""Personal information inside free text.

Places with an unmistakable form (e-mail addresses, phone numbers, street addresses) are protected
entities at once. Names and identity numbers have no such form: every candidate carries the terms
around it (its cues), and corpus co-occurrence estimates how strongly each cue reveals a protected
entity, as the information it gives: log2 of P(protected | cue) over the share of texts that hold
anything protected. Candidates with a cue beyond DISCLOSURE bits are replaced by the placeholder of
their type; all else stays as it is. Small corpora lean on a prior for words that announce a person.

Defined results: NULL, empty and blank texts hold nothing and stay as they are; overlapping places
count once (e-mail before phone, address, number, name); repeated rows are judged alike; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlume.session import materialised

DISCLOSURE = 2.0  # bits
PRIOR_WEIGHT = 8.0  # pseudo-observations of a cue
PRIOR_PERSON, PRIOR_OTHER = 0.9, 0.02

_UP = "A-ZÀ-ÖØ-ÞŁŚŻŠŽČ"
_LOW = "a-zß-öø-ÿąćęłńóśźżšžč"
_CAP = f"[{_UP}][{_LOW}’']+"
_PARTICLE = r"(?:(?:van|von|de|der|den|da|do|dos|di|du|la|le|el|bin|al)\s)"

# Words of street names and of building parts in several languages.
_STREET = "Street|St\\.|Road|Rd\\.|Lane|Avenue|Ave\\.?|Drive|Way|Close|Court|Square|Boulevard|Blvd\\.?|Terrace|Crescent|Place"
_POSTCODE = r"(?:\s[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|\s\d{5}(?:-\d{4})?)"
_TOWN = rf"(?:,\s*|\s*[\r\n]+\s*){_CAP}(?:[ -]{_CAP})?{_POSTCODE}?"

EMAIL = re.compile(
    # a local part has 64 characters at most and is tried once where its run of characters begins, so long runs take linear time
    r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|At)\s?[\])}]\s?|\sAT\s)[A-Za-z0-9\-]+"
    r"(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?|\sDOT\s)[A-Za-z0-9\-]+)+"
)
PHONE = re.compile(
    r"(?<![\w.\-/+])(?:"
    r"\+\d{1,3}[\s.\-]?(?:\(\d{1,5}\)[\s.\-]?)?\d(?:[\s.\-]?\d){6,11}"
    r"|\(0\d{2,5}\)\s?\d{2,4}[\s\-]\d{3,5}"
    r"|0\d{3,4}\s\d{5,7}"
    r"|00[1-9]\d?[\-\s.]\d{2,4}[\-\s.]\d{3,4}[\-\s.]\d{3,4}"
    r"|(?:1[\-\s.])?\(?\d{3}\)?[\s.\-]\d{3}[.\-]\d{4}"
    r")(?:\s?(?:ext\.?|x|Ext\.?)\s?\d{1,5})?(?![\w\-]|\.\d)"
)
ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\d+[A-Z]?,\s)?(?<![\w.])\d{{1,4}}[A-Z]?\s{_CAP}(?:\s{_CAP})?\s(?:{_STREET})(?!\w)(?:,\s(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\d+[A-Z]?)?(?:{_TOWN})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Rua)\s(?:{_PARTICLE})*{_CAP}(?:\s{_CAP})?,?\s\d{{1,4}}[A-Z]?(?:,\s\d{{1,2}}[ºª°])?(?:{_TOWN})?"
    rf"|(?<![\w.])\d{{1,4}}(?:\s?bis)?,?\s(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)\s(?:{_PARTICLE}|d['’])*{_CAP}(?:[ -]{_CAP})*(?:{_TOWN})?"
    rf"|{_CAP}(?:straße|strasse|str\.|weg|platz|gasse|allee)\s\d{{1,4}}[a-z]?(?:,\s\d{{5}}\s{_CAP})?"
)
NUMBER = re.compile(r"(?<![\w./\-+@#])(?:[A-Z]{1,4}-?)?\d[\dX]*(?:[ .\-]\d[\dX]+)*(?![\w@]|-\w)")
TITLE = r"(?:Dr|Prof|Professor|Mr|Mrs|Ms|Frau|Herr|Sra|Sr|Mme|M)\b\.?"
# Capitalised words that open a sentence or a line and are no given names.
_OPENERS = (
    "As|Call|The|This|That|These|Those|In|At|On|For|We|Our|My|His|Her|See|Please|Contact|Signed|Tel|Fax|From|With|If|It|An|And|But|Yours|Best|Kind|Dear|"
    "Thank|Thanks|Why|Have|Has|When|Which|Who|Is|Are|By|To|Of|Or|Mit|Veuillez|Figure|Fig|Table|Section|Methods|Results|Discussion|Introduction|Data|Both|"
    "Minor|Major|Overall|However|Here|There|After|Before|Flat|Apt|Reprints|Materials|Code|Doses|Reads|Funding|Catalogue"
)
_LAST = rf"{_CAP}(?:[{_LOW}{_UP}]*)(?:-{_CAP})*"
NAME = re.compile(
    rf"(?P<titled>(?:{TITLE}[ ])+)(?:{_CAP}[ ])?(?:[{_UP}]\.[ ]?)*{_PARTICLE}*{_LAST}(?:[ ]{_PARTICLE}*{_LAST})?"
    rf"|\b[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})*,[ ]{_CAP}(?![{_UP}])"
    rf"|\b(?!(?:{_OPENERS})\b){_CAP}[ ](?:[{_UP}]\.[ ]?)*{_PARTICLE}*{_LAST}"
)
LOWER_NAME = re.compile(
    rf"(?m)(?:^|(?<=\s)[\-–—*•]\s|^[\-–—*•]\s*)(?P<name>[{_LOW}]{{2,}}(?:-[{_LOW}]+)?\s(?:{_PARTICLE})*[{_LOW}]{{2,}}(?:-[{_LOW}]+)?),\s(?=(?:first|second|third|fourth|\w{{3,12}})\s(?:referee|reviewer|author|editor)\b)"
)

# Words that announce a person, and words that announce a number of a person.
PERSON_CUES = frozenset(
    "colleague colleagues volunteer participant patient referee reviewer signed sincerely regards wishes thank thanks call contact grüßen "
    "atentamente cordialement told lists name named editor author student supervisor mr mrs ms dear".split()
)
NUMBER_CUES = frozenset(
    "passport|id no|national id|id number|tax id|security number|social security|record number|patient record|researcher identifier|identifier|staff no|"
    "staff number|employee no|employee number|licence no|license no|insurance number|orcid|mrn|personal number|id card".split("|")
)
OTHER_NUMBER_CUES = frozenset("catalogue catalog grant accession registered doi doses dose range trial lot batch".split())
OTHER_CUES = frozenset("et equation test curve cohort syndrome disease lysis buffer street al method model regression".split())

CANDIDATE = "kind string, start int, stop int, left1 string, left2 string, right1 string, sure boolean, near boolean, tokens array<string>"
_PERSON_NEAR = re.compile(r"\b(?:my|his|her|participant|volunteer|patient)\b", re.I)
_TITLED = re.compile(TITLE + r"\s[A-Z]")
_BREAK = re.compile(r"[.!?]\s|[\r\n]{2}")
_TOKEN = re.compile(rf"[{_UP}{_LOW}’'-]{{2,}}")
_CUE_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _cues(text: str, start: int, stop: int) -> tuple[str, str, str]:
    """The word before, the two words before and the word after a place; punctuation and line ends are passed over."""
    before = _CUE_WORD.findall(text[max(0, start - 48) : start])
    after = _CUE_WORD.findall(text[stop : stop + 24])
    left = [w.lower() for w in before[-2:]]
    return (left[-1] if left else "^", " ".join(left) if left else "^", after[0].lower() if after else "$")


class _Spans:
    """Places in order of their start; none overlap, so a look takes a binary search."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, a)
        return (k == 0 or self.stops[k - 1] <= a) and (k == len(self.starts) or self.starts[k] >= b)

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.stops.insert(k, b)

    def within(self, a: int, b: int) -> bool:
        """Whether any place touches [a, b)."""
        return not self.free(a, b)

    def next_start(self, a: int) -> int | None:
        k = bisect_left(self.starts, a)
        return self.starts[k] if k < len(self.starts) else None


def candidates(text: str) -> list[tuple]:
    """Places of one text that may be personal, in the order of CANDIDATE; no two overlap."""
    out, taken, firm = [], _Spans(), _Spans()
    for kind, pattern in (("email", EMAIL), ("phone", PHONE), ("street_address", ADDRESS)):
        for m in pattern.finditer(text):
            if taken.free(*m.span()):
                taken.add(*m.span())
                firm.add(*m.span())
                out.append((kind, *m.span(), "", "", "", True, False, []))
    for m in NUMBER.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 6 and taken.free(*m.span()):
            a, b = m.span()
            taken.add(a, b)
            left1, left2, right = _cues(text, a, b)
            near = firm.within(max(0, a - 80), b + 80) or bool(_PERSON_NEAR.search(text, max(0, a - 120), b + 60)) or bool(_TITLED.search(text, max(0, a - 80), a))
            out.append(("id_number", a, b, left1, left2, right, False, near, []))
            if left2 in NUMBER_CUES or left1 in NUMBER_CUES:
                firm.add(a, b)
    for m in LOWER_NAME.finditer(text):
        a, b = m.span("name")
        if taken.free(a, b):
            taken.add(a, b)
            out.append(("person_name", a, b, "", "", "", True, False, m["name"].title().split()))
    for m in NAME.finditer(text):
        a, b = m.span()
        titled = m["titled"] is not None
        if titled:
            a = m.end("titled")
        if not taken.free(a, b):
            continue
        left1, left2, right = _cues(text, m.start(), b)
        # an entity right behind the name, with nothing but a cue word or two in between
        x = firm.next_start(b)
        near = x is not None and x - b <= 34 and not _BREAK.search(text, b, x)
        tokens = [w.title() for w in _TOKEN.findall(text, a, b) if w[0].isupper()]
        if titled or len(tokens) > 1:
            taken.add(a, b)
            out.append(("person_name", a, b, left1, left2, right, titled, near, tokens))
    return out


def find_candidates(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., candidate...) for each place of each text."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, *[x.split()[0] for x in CANDIDATE.split(", ")]]
        for b in batches:
            rows = [(*k, *c) for *k, t in b[[*keys, text]].itertuples(index=False, name=None) for c in candidates(t)]
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + CANDIDATE
    return texts.where(F.col(text).rlike(r"\S")).select(*keys, text).mapInPandas(run, schema)


def cue_disclosure(cands: DataFrame, texts_in_all: int) -> DataFrame:
    """(kind, cue, n, hits, bits): how strongly each cue reveals a protected entity of its kind.

    A name counts as protected where it has a title, stands right before an e-mail address, phone
    number, address or identity number, or consists of tokens that all occur in such names. An
    identity number counts where it stands beside one of these or beside words for a person.
    """
    names = cands.where("kind = 'person_name'").withColumn("no", F.monotonically_increasing_id())
    names = materialised(names.select("no", "left1", "left2", "right1", (F.col("sure") | F.col("near")).alias("seed"), "sure", "tokens"), "name-candidates")
    known = names.where("seed").select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("token")
    spread = names.where("not seed and size(tokens) > 1").select("no", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    whole = spread.join(known, "token", "left_semi").groupBy("no").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m")).where("k = m").select("no", F.lit(True).alias("all_known"))
    names = names.join(whole, "no", "left").withColumn("hit", F.col("seed") | F.coalesce("all_known", F.lit(False)))
    cue = lambda side, c: F.concat(F.lit(side), F.col(c))
    of_names = names.where("left1 <> '' or right1 <> ''").select(
        F.lit("person_name").alias("kind"), "hit", F.explode(F.array(cue("l:", "left1"), cue("ll:", "left2"), cue("r:", "right1"))).alias("cue")
    )
    of_numbers = cands.where("kind = 'id_number'").select(
        F.col("kind"), F.col("near").alias("hit"), F.explode(F.array(cue("l:", "left1"), cue("ll:", "left2"))).alias("cue")
    )
    counts = of_names.unionByName(of_numbers).groupBy("kind", "cue").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))
    words = F.split(F.regexp_replace("cue", "^[lr]+:", ""), " ")
    number, last = F.col("kind") == "id_number", F.element_at(words, -1)
    some = lambda names: F.arrays_overlap(words, F.array(*[F.lit(x) for x in sorted(names)]))
    person = (~number & last.isin(*PERSON_CUES)) | (number & (last.isin(*NUMBER_CUES) | F.array_join(words, " ").isin(*NUMBER_CUES)))
    other = F.when(number, some(OTHER_NUMBER_CUES)).otherwise(some(OTHER_CUES))
    prior = F.when(other, 0.0).when(person, PRIOR_PERSON).otherwise(PRIOR_OTHER)
    holders = cands.where("sure").select("table_name", "row_no", "field", "item").distinct().count()
    base = min(0.1, max(0.05, holders / max(1, texts_in_all)))
    # two words before a place lean on what the nearer one of them reveals, unless they are known by themselves
    one = counts.select("kind", "cue", "n", "hits", ((F.col("hits") + PRIOR_WEIGHT * prior) / (F.col("n") + PRIOR_WEIGHT)).alias("p"), person.alias("person"), other.alias("other"), last.alias("last"))
    near = one.where("cue like 'l:%'").select("kind", F.substring("cue", 3, 1000).alias("last"), F.col("p").alias("p_last"))
    two = one.join(near, ["kind", "last"], "left")
    lean = F.when(F.col("other"), 0.0).when(F.col("person"), PRIOR_PERSON).otherwise(F.coalesce("p_last", F.lit(PRIOR_OTHER)))
    p = F.when(F.col("cue").like("ll:%"), (F.col("hits") + PRIOR_WEIGHT * lean) / (F.col("n") + PRIOR_WEIGHT)).otherwise(F.col("p"))
    return two.select("kind", "cue", "n", "hits", F.coalesce(F.log2(p / base), F.lit(-99.0)).alias("bits"))


def personal_places(texts: DataFrame, text: str = "text") -> DataFrame:
    """(table_name, row_no, field, item, digest, start, stop, pii_type) of all places to be replaced; digest hashes the text."""
    keys = ["table_name", "row_no", "field", "item", "digest"]
    cands = materialised(find_candidates(texts.withColumn("digest", F.xxhash64(text)), keys, text), "personal-candidates")
    cues = materialised(cue_disclosure(cands, texts.where(F.col(text).rlike(r"\S")).count()), "cues")
    cands = cands.withColumn("no", F.monotonically_increasing_id())
    cands = materialised(cands, "numbered-candidates")
    side = lambda s, c: F.concat(F.lit(s), F.col(c))
    asked = cands.where("not sure").select("no", "kind", F.explode(F.array(side("l:", "left1"), side("ll:", "left2"), side("r:", "right1"))).alias("cue"))
    asked = asked.where("kind = 'person_name' or cue not like 'r:%'")
    # the strongest cue decides; numbers are judged by the two words before them where those are known
    best = asked.join(cues, ["kind", "cue"]).groupBy("no").agg(
        F.max("bits").alias("bits"), F.max(F.when(F.col("cue").startswith("ll:"), F.col("bits"))).alias("bits2")
    )
    judged = cands.join(best, "no", "left")
    name = F.col("sure") | (F.col("near") & (F.size("tokens") > 1)) | (F.coalesce("bits", F.lit(-9.0)) >= DISCLOSURE)
    number = F.coalesce("bits2", F.lit(-9.0)) >= DISCLOSURE
    keep = F.when(F.col("kind") == "person_name", name).when(F.col("kind") == "id_number", number).otherwise(F.lit(True))
    return judged.where(keep).select(*keys, "start", "stop", F.col("kind").alias("pii_type"))


def redacted(texts: DataFrame, places: DataFrame, placeholders: dict[str, str], text: str = "text") -> DataFrame:
    """(keys..., text): each place replaced by the placeholder of its type, all else unchanged."""
    keys = ["table_name", "row_no", "field", "item"]
    joint = [*keys, "digest"]
    texts = texts.withColumn("digest", F.xxhash64(text))
    marks = F.create_map(*[F.lit(x) for pair in placeholders.items() for x in pair])
    # keys are compared as values, NULL like any other, so no text stays open for want of a number, and
    # with the text, so rows that share a key keep their own places
    spans = places.groupBy(*joint).agg(F.array_sort(F.collect_set(F.struct("start", "stop", "pii_type"))).alias("spans")).withColumnsRenamed({k: f"of_{k}" for k in joint})
    same = [texts[k].eqNullSafe(spans[f"of_{k}"]) for k in joint]
    joined = texts.join(spans, same, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(
        s["stop"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), marks[s["pii_type"]]).alias("out")
    )
    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return joined.select(*keys, F.when(F.col("spans").isNull(), F.col(text)).otherwise(done).alias(text))
