"""Names of the domain queries, each with its Spark plan and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and national monthly rain departure as a ratio of area-weighted sums."""
    return QUERIES["a08_ratio_of_sums"](spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from agrolith.plans import audits, climate, domain, exports, features, inventory, learning, more, panel, payload, shapes, streams, surface, texts, verification  # noqa: F401


load()
