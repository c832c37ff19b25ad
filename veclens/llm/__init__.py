"""Operators for training-data pipelines, each with a registered query.

Nothing else in the library imports this subpackage. Every module registers
``opN_<name>`` in ``QUERIES`` and, where SQL can express it, in ``SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if given, the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


from . import (  # noqa: E402, F401 - registers the queries
    bitplane,
    exact_dedup,
    line_rules,
    lm_scoring,
    minhash,
    mixing,
    nbsvm,
    pieces,
    repair,
    sharding,
    spelling,
    substring_dedup,
    toxicity,
)
