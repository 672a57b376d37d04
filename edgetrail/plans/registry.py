"""The registered queries: name -> (Spark query, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .inputs import plain_times

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its instants are returned as wall-clock UTC."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(fn(tune(spark), sf_dir))

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return run

    return add
