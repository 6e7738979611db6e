"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle SQL if it has one."""
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


for _m in ("relational", "catalog", "textual", "retrieval", "stream", "ledger", "spatial", "resolution", "exchange", "scoring", "evidence"):
    importlib.import_module(f"tessera.plans.{_m}")
