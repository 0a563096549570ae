"""Operators for preparing training data, with one query each."""

from panmixia.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
