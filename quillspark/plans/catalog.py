"""Registered queries of the search, graph and ETL operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.model import ORACLE_TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None, tables: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Adds a query under its function's name; `tables` puts the adapters before the SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH RECURSIVE " if recursive else "WITH "
            ORACLE[f.__name__] = (head + ORACLE_TABLES.strip() + (", " if sql.lstrip().startswith("--cte") else "\n") + sql.replace("--cte", "", 1)) if tables else sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from quillspark.plans import document_queries, graph_queries, hierarchy_queries, load_queries, search_queries  # noqa: F401
