"""Registered queries: each area has ENTRIES, name -> (query, SQL or None)."""

from __future__ import annotations

from . import audits, graph, logs, pages, sources
from .views import oracle

AREAS = [logs, graph, audits, pages, sources]


def queries() -> dict:
    return {name: entry[0] for area in AREAS for name, entry in area.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(entry[1]) for area in AREAS for name, entry in area.ENTRIES.items() if entry[1]}
