"""Registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from . import graph_queries, report_queries, text_queries

QUERIES: dict = text_queries.QUERIES | graph_queries.QUERIES | report_queries.QUERIES
SQL: dict = text_queries.SQL | graph_queries.SQL | report_queries.SQL

flagship = text_queries.flagship
