"""Idempotent ingestion: classification of arrivals by key and fingerprint, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mnemoframe.functions.hashing import length_prefixed


def fingerprint() -> F.Column:
    """Of what an event says, without its idempotency key and without what differs between deliveries."""
    return length_prefixed(*(F.col(c) for c in ("tenant_id", "user_id", "agent_id", "source_id", "payload")))


def classify(arrivals: DataFrame) -> DataFrame:
    """Each arrival's disposition: the first of its (tenant, key) is ACCEPTED, a later one is a REPLAY if its fingerprint is the first's, else a CONFLICT.

    The first per key is a partial aggregate that is joined back, so a key delivered over and over is split by adaptive execution.
    """
    a = arrivals.select("tenant_id", "idempotency_key", "source_event_id", "trace_id", "received_at", fingerprint().alias("print"))
    order = F.struct(F.col("received_at").isNull().alias("late"), "received_at", F.coalesce("trace_id", F.lit("")).alias("trace_id"))
    first = a.groupBy("tenant_id", "idempotency_key").agg(F.min(F.struct(order.alias("o"), "print")).alias("f"))
    kind = F.when(order == F.col("f.o"), "ACCEPTED").when(F.col("print") == F.col("f.print"), "IDEMPOTENT_REPLAY").otherwise("CONFLICT")
    return a.join(first, ["tenant_id", "idempotency_key"]).select("tenant_id", "idempotency_key", "source_event_id", "trace_id", kind.alias("disposition"))


def new_arrivals(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Insert-or-ignore: the first of each new (tenant, key) that is not known yet."""
    fresh = batch.join(known.select("tenant_id", "idempotency_key"), ["tenant_id", "idempotency_key"], "left_anti")
    w = Window.partitionBy("tenant_id", "idempotency_key").orderBy(F.col("received_at").asc_nulls_last(), F.col("trace_id").asc_nulls_last())
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
