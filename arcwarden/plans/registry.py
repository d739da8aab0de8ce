"""All registered queries of the access-graph engine, and their SQL."""

from __future__ import annotations

from arcwarden.plans import bundle_queries, graph_queries, model_queries, record_queries, value_queries

_MODULES = (graph_queries, record_queries, value_queries, bundle_queries, model_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
entry = graph_queries.entry_query
