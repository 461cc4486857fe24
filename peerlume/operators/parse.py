"""Parsers of letters, model answers, JATS, HTML and DOCX as table functions."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how a reviewer's part of a letter begins, in any case, at a line's begin or after white space.
REVIEWER_HEADER = (
    r"(?:Reviewer\s*[#\-]?\s*(\d+)|Referee\s*[#\-]?\s*(\d+)|Review\s*(?:Report\s*)?(?:from\s+)?(?:Reviewer\s*)?(\d+))"
    r"(?:\s*\([^)]*\))?\s*[:\.\-]"
)

# Sub-article types of JATS by what they are.
LETTER_TYPES = ("decision-letter", "article-commentary", "editor-report", "aggregated-review-documents", "reviewer-report", "referee-report")
REPLY_TYPES = ("reply", "author-comment", "response")

# Severity and category of an extracted concern where the given one is unknown.
DEFAULT_CATEGORY, DEFAULT_SEVERITY, SHORTEST = "other", "minor", 10

# Order of sections in a prompt, and how much of each is kept.
SECTION_ORDER = ("introduction", "main", "results", "methods", "discussion")
SECTION_LIMITS = {"introduction": 4000, "main": 4000, "methods": 5000, "results": 5000, "discussion": 3000}
OTHER_LIMIT = 2000


def reviewer_blocks(letter: Column) -> Column:
    """Parts of a letter, each from one reviewer's heading to the next; the whole letter where there is none."""
    marked = F.regexp_replace(letter, f"(?i)(?:^|\\s)({REVIEWER_HEADER})", "\u0001$1")
    parts = F.transform(F.split(marked, "\u0001"), F.trim)
    some = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x != "")
    whole = F.filter(F.array(F.trim(letter)), lambda x: x != "")
    return F.when(letter.rlike(f"(?i)(?:^|\\s){REVIEWER_HEADER}"), some).otherwise(whole)


def response_boundary(blocks: DataFrame, doc: str, number: str, place: str) -> DataFrame:
    """(doc, place) of the first reviewer number that comes a second time: from there on authors respond."""
    n = blocks.groupBy(doc, number).agg(F.array_sort(F.collect_list(place)).alias("p")).where(F.size("p") > 1)
    return n.groupBy(doc).agg(F.min(F.get("p", 1)).alias(place))


def _mapped(f, kind: str):
    """Arrow-batched function over the values of a column; made on use, since it needs a session."""

    def run(c: pd.Series) -> pd.Series:
        return c.map(f)

    run.__annotations__ = {"c": pd.Series, "return": pd.Series}  # names, not strings, for the type of the function
    return F.pandas_udf(run, returnType=kind)


def json_array(text: str | None) -> list | None:
    """The JSON array in a model's answer: in a code fence, else from the first bracket that opens one to its end."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(\[.*?\])\s*```", text, re.S)
    spans = [fence.group(1)] if fence else []
    first, last = text.find("["), text.rfind("]")
    if first >= 0:
        short = re.search(r"\[.*?\]", text[first:], re.S)
        spans += [short.group(0)] if short else []
        spans += [text[first : last + 1]] if last > first else []
    for s in spans:
        try:
            found = json.loads(s)
        except ValueError:
            continue
        if isinstance(found, list):
            return found
    return None


def listed_items(text: str) -> list[str]:
    """Items of a numbered or bulleted list, without leading category labels in brackets or before a colon."""
    items = re.findall(r"(?m)^\s*(?:\d+[.)]|[-*•])\s+(.+?)\s*$", text or "")
    return [x for x in (re.sub(r"^(?:\[[^\]]{1,40}\]|\*\*[^*]{1,40}\*\*:?|[A-Z][a-z_ ]{2,30}:)\s*", "", i).strip() for i in items) if x]


def answer_texts(text: str | None) -> list[str]:
    """Concerns in a model's answer: a JSON array of strings or objects, else a list."""
    found = json_array(text)
    if found is None:
        return listed_items(text or "")
    return [str(x.get("text") or x.get("concern_text") or "") if isinstance(x, dict) else str(x) for x in found]


def answer_concerns(c: Column) -> Column:
    """Column form of :func:`answer_texts`."""
    return _mapped(answer_texts, "array<string>")(c)


def clean_extracted(rows: Column, categories: tuple[str, ...], severities: tuple[str, ...]) -> Column:
    """Extracted concerns with known labels; texts shorter than ten characters are dropped."""
    known = lambda v, allowed, default: F.when(v.isin(*allowed), v).otherwise(default)
    kept = F.filter(rows, lambda x: F.length(F.trim(x["text"])) >= SHORTEST)
    return F.transform(
        kept,
        lambda x: F.struct(F.trim(x["text"]).alias("text"), known(x["category"], categories, DEFAULT_CATEGORY).alias("category"), known(x["severity"], severities, DEFAULT_SEVERITY).alias("severity")),
    )


def prompt_text(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract and sections in their order, each cut at its limit with a mark."""
    def cut(name: str, limit: int) -> Column:
        s = sections[name]
        shown = F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("\n[…truncated]"))).otherwise(s)
        return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(f"{name.upper()}:\n"), shown))

    parts = [F.when(title != "", F.concat(F.lit("TITLE: "), title)), F.when(abstract != "", F.concat(F.lit("ABSTRACT:\n"), abstract))]
    parts += [cut(name, SECTION_LIMITS[name]) for name in SECTION_ORDER]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def _plain(e: ElementTree.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


JATS = "doi string, title string, abstract string, subjects array<string>, published string, sections array<struct<title:string,text:string>>, n_references int, letters array<string>, replies array<string>"


def jats_fields(xml: str | bytes) -> tuple:
    """The fields of one JATS article, in the order of JATS; sub-articles do not mix into the main text."""
    root = ElementTree.fromstring(xml)
    subs = [e for e in root.iter() if _local(e) in ("sub-article", "response")]
    letters = [_plain(next(iter(_all(s, "body")), None)) for s in subs if s.get("article-type") in LETTER_TYPES]
    replies = [_plain(next(iter(_all(s, "body")), None)) for s in subs if s.get("article-type", "response") in REPLY_TYPES]
    for parent in list(root.iter()):
        for s in [c for c in parent if c in subs]:
            parent.remove(s)
    doi = next((_plain(e) for e in _all(root, "article-id") if e.get("pub-id-type") == "doi"), "")
    titles = _all(root, "article-title")
    dates = sorted(_all(root, "pub-date"), key=lambda e: e.get("pub-type", e.get("date-type", "")) not in ("epub", "pub"))
    part = lambda d, n, default: next((_plain(e) for e in d if _local(e) == n), default)
    published = f"{part(dates[0], 'year', '')}-{part(dates[0], 'month', '1').zfill(2)}-{part(dates[0], 'day', '1').zfill(2)}" if dates else ""
    body = next(iter(_all(root, "body")), None)
    sections = [(_plain(next((c for c in s if _local(c) == "title"), None)), " ".join(_plain(c) for c in s if _local(c) != "title")) for s in (body if body is not None else []) if _local(s) == "sec"]
    return (doi, _plain(titles[0]) if titles else "", _plain(next(iter(_all(root, "abstract")), None)), [_plain(e) for e in _all(root, "subject")], published, sections, len(_all(root, "ref")), letters, replies)


def parse_jats(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, fields of JATS..., error): one row per document; broken XML gives its error and no fields."""
    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ (?:string|array|int))", JATS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b[key], b[xml]):
                try:
                    rows.append((k, *jats_fields(x), None))
                except (ElementTree.ParseError, TypeError) as e:
                    rows.append((k, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return df.select(key, xml).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {JATS}, error string")


class _Visible(HTMLParser):
    """Headed sections and visible text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.heading, self.out, self.sections = 0, False, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.heading = True
            self.sections.append(["", ""])
        elif tag in ("p", "br", "div", "li"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.heading = False

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.out.append(data)
        if self.sections:
            self.sections[-1][0 if self.heading else 1] += data


def html_sections_of(page: str | None) -> list[tuple[str, str]]:
    """(heading, text) of a page, white space levelled."""
    v = _Visible()
    v.feed(page or "")
    return [(" ".join(a.split()), " ".join(b.split())) for a, b in v.sections]


def html_sections(c: Column) -> Column:
    """(heading, text) structs of a page: column form of :func:`html_sections_of`."""
    return _mapped(lambda x: [dict(zip(("title", "text"), s)) for s in html_sections_of(x)], "array<struct<title:string,text:string>>")(c)


def docx_text_of(content: bytes) -> str:
    """Paragraphs of a DOCX file, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(x for x in ("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in _all(root, "p")) if x.strip())


def docx_text(c: Column) -> Column:
    """Column form of :func:`docx_text_of`; NULL for files that are no DOCX."""

    def one(b: bytes) -> str | None:
        try:
            return docx_text_of(b)
        except (zipfile.BadZipFile, KeyError, TypeError, ElementTree.ParseError):
            return None

    return _mapped(one, "string")(c)


def pdf_blocks(text: Column, least: int = 150) -> Column:
    """Reviewer blocks of a text taken from a PDF: the cover is skipped, short blocks are dropped, responses cut off."""
    start = F.regexp_instr(text, F.lit(f"(?i){REVIEWER_HEADER}"))
    body = F.when(start > 0, F.substr(text, start)).otherwise(text)
    body = F.split(body, r"(?im)^\s*(?:author(?:s'|'s)? (?:response|rebuttal)|response to (?:the )?(?:reviewers|referees)|point[- ]by[- ]point)\b", 2)[0]
    return F.filter(reviewer_blocks(body), lambda b: F.length(b) >= least)
