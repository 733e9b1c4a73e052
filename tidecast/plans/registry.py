"""The queries of the planning library, each with the SQL it is held against where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
AREAS = ("scans", "resolution", "series", "evaluation", "commercial", "governance", "risk", "models")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"tidecast.plans.{area}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
