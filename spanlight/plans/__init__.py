"""Queries over whole tables, each with the SQL that DuckDB runs for the same rows."""

from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
