"""All queries over the driver's tables, with the SQL of each that SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import company_queries, panel_queries, section_queries, source_queries, tone_queries

_ALL = tone_queries.QUERIES | section_queries.QUERIES | company_queries.QUERIES | panel_queries.QUERIES | source_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
