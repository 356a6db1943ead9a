"""Name -> query and name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, *needs: str):
    """Register a query; ``select`` over the named expressions is its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if select is not None:
            ORACLES[name] = sql(select, *needs)
        return fn

    return register
