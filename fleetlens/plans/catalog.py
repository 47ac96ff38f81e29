"""The registry of queries, each next to its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.fragments import sql
from fleetlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, needs: list[str] | None = None, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` is SQL over the fragments in ``needs``."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            if name.startswith("stream_"):
                # A stream fixes its number of state partitions when it first starts, and AQE does not merge
                # them: a session of its own has as many as there are cores.
                spark = spark.newSession()
                spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
            tune(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = sql(needs or [], oracle)
        return fn
    return add


def load() -> None:
    from fleetlens.plans import (  # noqa: F401
        queries_compare, queries_events, queries_exprs, queries_live, queries_sources, queries_state)
