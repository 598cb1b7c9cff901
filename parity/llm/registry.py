"""Registry of the queries of this subpackage, each beside its SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parity.session import apply_defaults, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def prepared(fn: Callable) -> Callable:
    """``fn`` with the library's settings and a shared checkpoint folder on the session it is given."""

    def run(spark: SparkSession, *args) -> DataFrame:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return fn(apply_defaults(spark), *args)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL the tests hold it against brute force."""

    def register(fn: Query) -> Query:
        QUERIES[name] = prepared(fn)
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
