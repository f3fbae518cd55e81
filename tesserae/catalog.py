"""Every registered query and its DuckDB counterpart."""

from __future__ import annotations

from .queries import documents, formats, mappings, series

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (mappings, series, formats, documents):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
