"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load() -> None:
    """Import every query module."""
    from catalog import (  # noqa: F401
        q_anomaly, q_cleaning, q_cluster, q_dashboard, q_dictionary, q_enrich, q_keywords, q_merge, q_panels,
        q_sampling, q_scoring, q_sources, q_tables, q_validate,
    )
