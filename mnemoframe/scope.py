"""The mandatory scope of every read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Scope:
    """Tenant, and optionally user and agent; only parts that are set become predicates, so they reach the scan."""

    tenant_id: str
    user_id: str | None = None
    agent_id: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.where(F.col("tenant_id") == self.tenant_id)
        for name in ("user_id", "agent_id"):
            value = getattr(self, name)
            df = df if value is None else df.where(F.col(name) == value)
        return df
