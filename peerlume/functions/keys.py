"""Canonical keys of articles: DOIs, article ids, category spellings, comparable words.

Everything here is a plain ``Column`` expression, so it stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that carry no meaning inside an identifier, and look-alikes of "-".
INVISIBLE = r"[\s ­​-‏⁠﻿]"
DASHES = r"[‐-―−]"

# Registrant prefix of each source whose article ids hold no DOI.
DOI_PREFIX_OF_SOURCE = {"elife": "10.7554/elife.", "peerj": "10.7717/peerj.", "nature": "10.1038/"}


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with ``c`` evaluated once, however often and in whatever branch the body uses it."""
    return F.transform(F.array(c), body)[0]


def _squeezed(c: Column) -> Column:
    """Lower case, percent-escapes of "/" undone, one kind of dash, no invisible characters."""
    c = F.lower(F.regexp_replace(c, INVISIBLE, ""))
    return F.regexp_replace(F.regexp_replace(c, "%2f", "/"), DASHES, "-")


def canonical_doi(c: Column) -> Column:
    """DOI in one spelling, its version kept; NULL for NULL, blanks and stand-ins.

    A stand-in is whatever holds no ``10.<registrant>/<suffix>`` or uses the registrant 0000.
    """
    found = F.regexp_extract(_squeezed(c), r"(10\.\d{4,9}/.*[^\s./,;:)\]])", 1)
    return once(found, lambda x: F.when((x != "") & ~x.startswith("10.0000/"), x))


def canonical_id(c: Column) -> Column:
    """Article id in one spelling, its version kept; NULL for NULL and blank ids."""

    def spelled(s: Column) -> Column:
        rest = F.substring(s, F.instr(s, ":") + 1, F.length(s))
        rest = F.when(rest.startswith("10."), F.regexp_replace(rest, r"^(10\.\d{4,9})_", "$1/")).otherwise(rest)
        return F.when(s != "", F.when(s.contains(":"), F.concat(F.substring_index(s, ":", 1), F.lit(":"), rest)).otherwise(s))

    return once(_squeezed(c), spelled)


def without_version(doi: Column) -> Column:
    """Canonical DOI without a trailing version (``.2``, ``.v2``, ``v2`` after four digits or more)."""
    return F.regexp_replace(doi, r"^(.*\d{4,})(?:\.v?|v)\d{1,3}$", "$1")


def manuscript_of_doi(c: Column) -> Column:
    """Key of the manuscript that a DOI names, whatever its spelling or version."""
    return without_version(canonical_doi(c))


def manuscript_of_id(c: Column) -> Column:
    """Key of the manuscript that an article id names; comparable with :func:`manuscript_of_doi`."""

    def key(s: Column) -> Column:
        source, rest = F.substring_index(s, ":", 1), F.substring(s, F.instr(s, ":") + 1, F.length(s))
        prefix = F.lit(None).cast("string")
        for name, doi in DOI_PREFIX_OF_SOURCE.items():
            prefix = F.when(source == name, F.lit(doi)).otherwise(prefix)
        return F.when(rest.startswith("10."), rest).when(prefix.isNotNull(), F.concat(prefix, rest)).otherwise(s)

    return without_version(once(canonical_id(c), key))


def category(c: Column) -> Column:
    """Spelling of a category: trimmed, lower case, words joined by ``_``; NULL for NULL and blanks."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[\s _-]+", " ")), " ", "_")
    return once(s, lambda x: F.when(x != "", x))


# Short forms of editorial decisions.
DECISION_ALIASES = {
    "accepted": "accept", "minor": "minor_revision", "minor_revisions": "minor_revision",
    "major": "major_revision", "major_revisions": "major_revision", "rejected": "reject",
}


def decision(c: Column) -> Column:
    """Editorial decision in one spelling; missing or blank as ``unknown``."""
    full = F.create_map(*[F.lit(x) for pair in DECISION_ALIASES.items() for x in pair])
    return F.coalesce(F.transform(F.array(category(c)), lambda s: F.coalesce(full[s], s))[0], F.lit("unknown"))


# Texts that stand where an abstract is missing.
ABSTRACT_STAND_INS = (
    "abstract missing", "no abstract", "no abstract available", "abstract not available", "abstract unavailable",
    "not available", "n a", "na", "none", "null", "tbd", "to be added", "missing",
)


def comparable_words(c: Column) -> Column:
    """Different words of a text after case, punctuation, markup and white space are levelled; never NULL."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^<>]{0,200}>", " ")
    s = F.regexp_replace(s, r"&(?:amp|nbsp|lt|gt|quot|#\d{1,6});", " ")
    return F.array_distinct(F.array_remove(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), ""))


def abstract_words(c: Column) -> Column:
    """As :func:`comparable_words`, but empty for the stand-ins of a missing abstract."""
    none = F.array().cast("array<string>")
    return once(comparable_words(c), lambda w: F.when((F.size(w) <= 4) & F.array_join(w, " ").isin(*ABSTRACT_STAND_INS), none).otherwise(w))
