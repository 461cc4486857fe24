"""Renderers of small results: markdown tables, leaderboards, drift checks, validation packs."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from typing import Any


def markdown_table(rows: Iterable[dict[str, Any]], columns: Sequence[str], digits: int = 4) -> str:
    """Rows as a markdown table; numbers are rounded here and nowhere else."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def leaderboard_markdown(rows: Iterable[dict[str, Any]], note: str = "") -> str:
    """Ranked runs with a note on the matcher."""
    return "# Leaderboard\n\n" + markdown_table(rows, ("rank", "tool", "version", "f1", "recall")) + (f"\n{note}\n" if note else "")


def matcher_note(method: str, threshold: float, algorithm: str) -> str:
    """What a score was made with, in one line."""
    return f"[matcher: {method}, threshold {threshold:g}, {algorithm}]"


def with_note(text: str, note: str) -> str:
    """Free text with a note appended once."""
    return text if note in text else f"{text} {note}".strip()


def console_report(summary: dict[str, Any]) -> str:
    """A result as aligned lines."""
    width = max(map(len, summary), default=0)
    return "\n".join(f"{k:<{width}}  {v:.4f}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in summary.items())


def normalised(text: str) -> str:
    """Text for comparison: line ends and trailing blanks levelled, time stamps masked."""
    text = re.sub(r"\d{4}-\d{2}-\d{2}T[\d:.+Z-]+", "<time>", text.replace("\r\n", "\n"))
    return "\n".join(x.rstrip() for x in text.split("\n")).strip() + "\n"


def drift(expected: dict[str, str], found: dict[str, str]) -> dict[str, str]:
    """Differences of rendered artifacts by name; empty if nothing has changed."""
    out = {}
    for name in sorted(expected.keys() | found.keys()):
        a, b = normalised(expected.get(name, "")), normalised(found.get(name, ""))
        if name not in expected or name not in found:
            out[name] = "missing" if name not in found else "unexpected"
        elif a != b:
            out[name] = "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "expected", "found"))
    return out


def release_manifest(files: dict[str, bytes]) -> list[dict[str, Any]]:
    """(path, sha256, bytes) of small artifacts in order of path."""
    return [{"path": p, "sha256": hashlib.sha256(b).hexdigest(), "bytes": len(b)} for p, b in sorted(files.items())]


def input_fingerprint(rows: Iterable[dict[str, Any]]) -> str:
    """SHA-256 of rows in canonical JSON."""
    return hashlib.sha256(json.dumps(list(rows), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def dataset_card(name: str, counts: dict[str, int], size_category: str, license_name: str) -> str:
    """A data card with its YAML head."""
    head = f"---\nlicense: {license_name}\nsize_categories:\n- {size_category}\n---\n"
    return head + f"\n# {name}\n\n" + markdown_table([{"split": k, "articles": v} for k, v in counts.items()], ("split", "articles"))


def documentation_problems(text: str, expected: dict[str, int]) -> list[str]:
    """Counts that a document should name but does not (thousands may be separated)."""
    plain = text.replace(",", "")
    return [f"{k}: {v} not found" for k, v in expected.items() if not re.search(rf"\b{v}\b", plain)]


def identity_code(suspicious: bool) -> str:
    """Outcome of a check for identical labels, for the caller to word."""
    return "identical" if suspicious else "different"
