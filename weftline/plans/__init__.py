"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import eval_queries, route_queries, text_queries, vector_queries

_MODULES = (text_queries, route_queries, eval_queries, vector_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
