"""General relational building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(*columns: Column | str) -> list[Column]:
    """Ascending, nulls last, as in other SQL engines."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in columns]


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the partial rank limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def optional(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters for those values that are given: no ``IS NULL OR`` in the plan."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    return df


def keyset_page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """A page of ``size`` rows after a key, and one more that tells whether another page follows."""
    df = df if after is None else df.where(F.col(key) > after)
    return df.orderBy(key).limit(size + 1)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Old and new rows merged by key; a row only gives way to one of a greater or equal sequence that comes later."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, F.col(sequence).desc_nulls_last(), F.desc("_new")).drop("_new")


def one_of_copies(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null key; copies are equal, so which one stays does not matter."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded half-even; null where the whole is zero."""
    return F.when(whole != 0, F.bround(part / whole, digits))
