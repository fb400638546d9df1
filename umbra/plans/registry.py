"""Queries over the driver's tables, one per operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbra.plans import drawing_queries, evidence_queries, geometry_queries, scoring_queries, unicode_queries

FLAGSHIP = "flagship_unicode_severity"
ALL = unicode_queries.QUERIES | scoring_queries.QUERIES | evidence_queries.QUERIES | geometry_queries.QUERIES | drawing_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to callable (spark, sf_dir)."""
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for name, (_, sql) in ALL.items() if sql}
