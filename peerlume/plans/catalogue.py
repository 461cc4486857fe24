"""All queries of the core and their SQL."""

from __future__ import annotations

from peerlume.plans import analysis, checks, corpus, evaluation, ingest
from peerlume.plans.registry import Query

_PARTS = (evaluation, corpus, analysis, ingest, checks)
QUERIES: dict[str, Query] = {name: f for part in _PARTS for name, f in part.R.queries.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.R.sql.items()}
