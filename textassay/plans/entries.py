"""All queries of the reference's own operators, with their DuckDB SQL (None: rows only)."""

from __future__ import annotations

from .lint_queries import QUERIES as LINT
from .source_queries import QUERIES as SOURCES

ENTRIES = LINT | SOURCES
#: Reports of every document.
flagship = ENTRIES["lint_report"][0]

__all__ = ["ENTRIES", "flagship"]
