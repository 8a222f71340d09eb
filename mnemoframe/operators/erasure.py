"""Governed erasure as set operations: what tombstones reach, and tables without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoframe.functions.text import trimmed_key


def erased(tombstones: DataFrame, object_type: str) -> DataFrame:
    """Distinct (tenant_id, key) of erased objects of a type."""
    return tombstones.where(F.col("object_type") == object_type).select("tenant_id", trimmed_key(F.col("object_id")).alias("key")).where(F.col("key").isNotNull()).distinct()


def hidden(df: DataFrame, tombstones: DataFrame, object_type: str, key: str) -> DataFrame:
    return df.withColumn("key", trimmed_key(F.col(key))).join(erased(tombstones, object_type), ["tenant_id", "key"], "left_semi").drop("key")


def remaining(df: DataFrame, tombstones: DataFrame, object_type: str, key: str) -> DataFrame:
    return df.withColumn("key", trimmed_key(F.col(key))).join(erased(tombstones, object_type), ["tenant_id", "key"], "left_anti").drop("key")


def redacted(df: DataFrame, tombstones: DataFrame, object_type: str, key: str, columns: tuple[str, ...], state: str | None = None) -> DataFrame:
    """All rows; those reached have the columns emptied and their state set to ERASED. One join, no rewrite of other columns."""
    gone = erased(tombstones, object_type).withColumn("gone", F.lit(True))
    j = df.withColumn("key", trimmed_key(F.col(key))).join(gone, ["tenant_id", "key"], "left")
    hit = F.coalesce("gone", F.lit(False))
    out = j.withColumns({c: F.when(~hit, F.col(c)) for c in columns})
    if state:
        out = out.withColumn(state, F.when(hit, F.lit("ERASED")).otherwise(F.col(state)))
    return out.select(*df.columns)


def new_tombstones(wanted: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Those of (tenant_id, object_type, object_id) that have no tombstone yet: applying it twice adds nothing."""
    key = ["tenant_id", "object_type", "object_id"]
    return wanted.select(*key).distinct().join(tombstones.select(*key), key, "left_anti")
