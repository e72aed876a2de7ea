"""Queries composed of operators, and their SQL."""

from . import queries, queries2, queries3

QUERIES, SQL = queries.QUERIES, queries.SQL

__all__ = ["QUERIES", "SQL", "queries2", "queries3"]
