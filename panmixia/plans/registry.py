"""Named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB's version of it, or what makes it, if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from panmixia.plans import queries_decode, queries_genes, queries_panel, queries_selection, queries_sources  # noqa: E402  these fill the registry


def oracle_sql() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for name, sql in ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel to landscape: segregating sites, pairs within populations, the Gamma filter, and per-site mean, minimum and maximum."""
    return QUERIES["within_population_landscape"](spark, sf_dir)
