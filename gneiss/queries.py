"""All queries of the library but those of its corpus subpackage, and their SQL."""

from __future__ import annotations

from .plans import catalog_queries, generation_queries, integrity_queries, relational_queries, validation_queries

_MODULES = (validation_queries, integrity_queries, relational_queries, catalog_queries, generation_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
