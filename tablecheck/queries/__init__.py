"""Registered queries and their oracle SQL."""

from __future__ import annotations

from tablecheck.queries import parity_queries, relational_queries, text_queries, told_queries

MODULES = (parity_queries, relational_queries, text_queries, told_queries)
QUERIES = {name: f for m in MODULES for name, f in m.REGISTRY.queries.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.REGISTRY.sql.items()}
