"""Every operator as a query on the test tables, next to equivalent SQL.

Topic modules register their checks with ``check``; importing this package
loads them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if given, the SQL that must give the same rows."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return register


from . import (  # noqa: E402, F401 - registers the checks
    chunks,
    corpus,
    features,
    jobs,
    runs,
)
