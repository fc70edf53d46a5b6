"""All queries of the library proper, and their SQL where it can be said in SQL."""

from __future__ import annotations

from lamina.plans import relational, rewriting, trips

_MODULES = (relational, rewriting, trips)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
