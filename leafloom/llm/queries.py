"""All queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from leafloom.llm import entry_matching, format_duplicates, languages, lookalikes, mixing, neighbours, packing, vector_clusters

_MODULES = [format_duplicates, lookalikes, entry_matching, vector_clusters, neighbours, packing, mixing, languages]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
