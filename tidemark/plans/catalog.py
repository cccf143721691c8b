"""Queries by name over the shared test tables, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_queries, panel_queries, table_queries, text_queries

FLAGSHIP = "adjacent_similarity_turns"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | table_queries.QUERIES | event_queries.QUERIES | panel_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.ORACLE | table_queries.ORACLE | event_queries.ORACLE | panel_queries.ORACLE
