"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.plans import assessment, chains, history, memories, records, retrieval, upkeep

_PARTS = (history, retrieval, memories, assessment, chains, records, upkeep)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rrf_fusion(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
