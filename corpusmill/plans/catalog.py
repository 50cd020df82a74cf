"""All queries of the engine and their SQL statements, by name."""

from __future__ import annotations

from corpusmill.plans import corpus_queries, retrieval_queries, system_queries, text_queries

_MODULES = (text_queries, corpus_queries, retrieval_queries, system_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
