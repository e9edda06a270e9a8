"""The registry of core queries and of the SQL they are checked against."""

from __future__ import annotations

from leafloom.operators import hierarchy, references
from leafloom.plans import further_queries, graph_queries, model_queries, page_queries, relational_queries, text_queries

_MODULES = [graph_queries, hierarchy, references, text_queries, relational_queries, model_queries, further_queries, page_queries]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
