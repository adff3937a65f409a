"""Queries over the test tables, by family, with their oracle SQL."""

from __future__ import annotations

from . import chat_queries, dedup_queries, learning_queries, relational_queries, release_queries, select_queries, series_queries, source_queries, text_queries

_FAMILIES = (text_queries, dedup_queries, select_queries, chat_queries, relational_queries, source_queries, release_queries, series_queries, learning_queries)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
