"""The subpackage's queries and their SQL statements."""

from __future__ import annotations

from corpusmill.llm import exact_dup, html_text, language_id, license_scan, near_dup, packing, phrases, quality_cnn, sentence_pieces, source_mix, url_filter, vector_codes, vector_topk

_MODULES = (url_filter, quality_cnn, source_mix, license_scan, language_id, packing, near_dup, exact_dup, html_text, vector_topk, sentence_pieces, vector_codes, phrases)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
