"""All registered queries of the document engine and their DuckDB counterparts."""

from __future__ import annotations

from . import document_queries, kernel_queries, page_queries, relational_queries, source_queries, structure_queries, text_queries

MODULES = (kernel_queries, relational_queries, document_queries, page_queries, text_queries, structure_queries, source_queries)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
FLAGSHIP = "page_report"
