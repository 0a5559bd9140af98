"""Queries of the core and their SQL."""

from __future__ import annotations

from weftdocs.plans import answers, cells, documents, entities, forms, reports, retrieval, search, stats, streams

MODULES = [search, stats, entities, documents, streams, forms, answers, reports, cells, retrieval]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "search_lines_by_idf"
