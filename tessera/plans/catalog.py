"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import composite_queries, lifecycle_queries, model_queries, monitor_queries, stream_queries, table_queries, url_queries

FLAGSHIP = "url_host_profile"
QUERIES = url_queries.QUERIES | table_queries.QUERIES | stream_queries.QUERIES | composite_queries.QUERIES | monitor_queries.QUERIES | lifecycle_queries.QUERIES | model_queries.QUERIES
ORACLE_SQL = url_queries.SQL | table_queries.SQL | stream_queries.SQL | composite_queries.SQL | monitor_queries.SQL | lifecycle_queries.SQL | model_queries.SQL
