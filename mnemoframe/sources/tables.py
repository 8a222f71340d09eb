"""Parquet tables of a scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoframe.session import share_code


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``, only the given columns if any are named."""
    share_code(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
