"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (read, spark), where ``read`` gives a table by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(t: str) -> DataFrame:
                return table(spark, sf_dir, t)

            read.path = lambda t: f"{sf_dir}/{t}.parquet"
            return f(read, spark)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
