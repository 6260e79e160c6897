"""All registered queries of the bar engine, and the SQL that they are compared with."""

from __future__ import annotations

from tidemark import oracles, queries, stream_queries

QUERIES = queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | oracles.ORACLE_SQL | stream_queries.ORACLE_SQL
