"""The queries over the given tables, and their SQL."""

from __future__ import annotations

from . import q_catalog, q_geometry, q_metrics, q_neighbors, q_text

MODULES = (q_catalog, q_geometry, q_metrics, q_neighbors, q_text)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
