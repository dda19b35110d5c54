"""All registered queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "hybrid_search"
MODULES = ("text", "chunks", "formats", "search", "index", "selection", "routing", "sessions", "calls", "trajectories", "streams", "relational", "plans")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = fn
        if sql:
            _ORACLES[key] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"sparkquill.queries.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
