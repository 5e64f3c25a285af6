"""All queries over the knowledge-base operators, by name, and their SQL."""

from __future__ import annotations

from docweave.plans import composite_queries, evaluation_queries, governance_queries, graph_queries, io_queries, search_queries, stats_queries, text_queries

MODULES = (text_queries, stats_queries, evaluation_queries, search_queries, graph_queries, composite_queries, governance_queries, io_queries)
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
