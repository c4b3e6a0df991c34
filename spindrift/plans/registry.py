"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import analysis_queries, cohort_queries, document_queries, rank_queries, review_queries, source_queries, study_queries, text_queries, unit_queries

_MODULES = (text_queries, unit_queries, rank_queries, cohort_queries, study_queries, analysis_queries, source_queries, document_queries, review_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
