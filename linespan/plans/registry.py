"""All queries of the engine, and their SQL."""

from __future__ import annotations

from . import analytics_queries, assembly_queries, check_queries, chunk_queries, job_queries, line_queries, stream_queries

_PARTS = (line_queries, check_queries, analytics_queries, job_queries, chunk_queries, assembly_queries, stream_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
