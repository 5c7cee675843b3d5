"""The registered queries: every operator of the library over the given tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the equivalent text for the comparison engine."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n")).strip()
        return function

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from registry import (  # noqa: F401
        aggregate_queries,
        check_queries,
        column_queries,
        file_queries,
        job_queries,
        join_queries,
        layout_queries,
        order_queries,
        record_queries,
        stream_queries,
        table_queries,
    )
