"""The queries of all problems in this subpackage, and their SQL where it can be said in SQL."""

from __future__ import annotations

from lamina.llm import consensus, heavy, increment, lookalike, mixture, mojibake, packing, passages, quality, variants

_MODULES = (variants, passages, consensus, increment, lookalike, mojibake, heavy, packing, mixture, quality)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
