"""All queries of the audit engine, by name, and their equivalents in SQL."""

from __future__ import annotations

from glyphlake.plans import document_queries, report_queries, text_queries, visual_queries

_PARTS = (text_queries, visual_queries, document_queries, report_queries)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE: dict = {k: q for part in _PARTS for k, q in part.ORACLE.items()}
