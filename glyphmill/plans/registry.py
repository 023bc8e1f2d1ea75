"""Queries of the engine by id, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under a name."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
