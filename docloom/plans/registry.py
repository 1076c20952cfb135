"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("text", "chunks", "retrieval", "context", "evaluation", "analysis", "ingest", "extraction", "graphs", "markup", "more", "provider")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (session, data folder) under its name, with the SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        key = name or function.__name__
        _QUERIES[key] = function
        if sql is not None:
            _SQL[key] = sql
        return function

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        import_module(f"docloom.plans.{m}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where an input has fewer pieces than there are cores; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 < cores else df
