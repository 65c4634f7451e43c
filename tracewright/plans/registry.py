"""Registration of named queries with the SQL they are held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of session and data directory; without SQL the result is tested against brute force instead."""

    def put(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return run

    return put
