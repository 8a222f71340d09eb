"""Bitemporal history: status log, current state, as-of, diff, listing and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.operators.relational import latest_per_key, one_of_copies


def status_log(versions: DataFrame, lineages: DataFrame) -> DataFrame:
    """Status changes of versions recorded in order: each becomes CURRENT, and of a SINGLE lineage HISTORICAL with the next one.

    Copies count once; versions without a lineage of their tenant are left out.
    """
    v = one_of_copies(versions.select("tenant_id", "memory_id", "version_id", "version_number", "transaction_time"), "version_id")
    # grouped by the join's keys, so that the join needs no further shuffle of this side
    kinds = lineages.where(F.col("memory_id").isNotNull()).groupBy("tenant_id", "memory_id").agg(F.min("predicate_cardinality").alias("predicate_cardinality"))
    w = Window.partitionBy("tenant_id", "memory_id").orderBy("version_number", "version_id")
    joined = v.join(kinds, ["tenant_id", "memory_id"]).withColumns({"next_n": F.lead("version_number").over(w), "next_at": F.lead("transaction_time").over(w)})
    born = F.struct(F.col("version_number").alias("sequence"), F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("from_status"), F.lit("CURRENT").alias("to_status"), F.col("transaction_time").alias("occurred_at"))
    gone = F.struct(F.col("next_n").alias("sequence"), F.lit(1).alias("ordinal"), F.lit("CURRENT").alias("from_status"), F.lit("HISTORICAL").alias("to_status"), F.col("next_at").alias("occurred_at"))
    changes = F.when((F.col("predicate_cardinality") == "SINGLE") & F.col("next_n").isNotNull(), F.array(born, gone)).otherwise(F.array(born))
    return joined.select("tenant_id", "memory_id", "version_id", F.explode(changes).alias("c")).select("tenant_id", "memory_id", "version_id", "c.*")


def current_state(log: DataFrame) -> DataFrame:
    """The last change of each version; the keys extend those the log is already partitioned by."""
    last = latest_per_key(log, ["tenant_id", "memory_id", "version_id"], F.desc("sequence"), F.desc("ordinal"))
    return last.select("tenant_id", "memory_id", "version_id", F.col("to_status").alias("status"), F.col("occurred_at").alias("since"))


def current_state_incremental(log: DataFrame) -> DataFrame:
    """The same by one partial aggregate without a window or sort: what an incremental upsert arrives at."""
    last = F.max_by(F.struct("to_status", "occurred_at"), F.struct("sequence", "ordinal"))
    return log.groupBy("tenant_id", "memory_id", "version_id").agg(last.alias("l")).select("tenant_id", "memory_id", "version_id", F.col("l.to_status").alias("status"), F.col("l.occurred_at").alias("since"))


def as_of(log: DataFrame, at: Column) -> DataFrame:
    """States of versions recorded at or before ``at`` (transaction time)."""
    return current_state(log.where(F.col("occurred_at") <= at))


def as_of_many(log: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: for each probe (probe_id, memory_id, probe_time), each version's status at that time.

    Every change holds from its time until the earliest one after it in the version's order, so a probe meets one change of a version and
    what the join gives is the answer: nothing is aggregated after it.
    """
    later = Window.partitionBy("tenant_id", "memory_id", "version_id").orderBy("sequence", "ordinal").rowsBetween(1, Window.unboundedFollowing)
    held = log.withColumn("until", F.min("occurred_at").over(later)).where(F.col("until").isNull() | (F.col("until") > F.col("occurred_at")))
    now = (F.col("occurred_at") <= F.col("probe_time")) & (F.col("until").isNull() | (F.col("until") > F.col("probe_time")))
    return held.join(probes, "memory_id").where(now).select("probe_id", "memory_id", "version_id", F.col("to_status").alias("status"))


def diff(log: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Per version the status at ``after`` (exclusive start) and at ``upto``, where they differ; null before it was recorded."""
    key = F.struct("sequence", "ordinal")
    both = log.where(F.col("occurred_at") <= upto).groupBy("memory_id", "version_id").agg(
        F.max_by(F.when(F.col("occurred_at") <= after, F.col("to_status")), F.when(F.col("occurred_at") <= after, key)).alias("old_status"), F.max_by("to_status", key).alias("new_status")
    )
    return both.where(~F.col("old_status").eqNullSafe(F.col("new_status")))


def status_counts(state: DataFrame) -> DataFrame:
    """Per lineage the number of versions by status."""
    return state.groupBy("memory_id").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("CURRENT", "HISTORICAL", "CONFLICTED", "INVALIDATED")))


def lineage_list(lineages: DataFrame, versions: DataFrame, state: DataFrame) -> DataFrame:
    """Lineages with version counts, counts by status and last transaction; each side is aggregated before it is joined, so nothing fans out."""
    last = one_of_copies(versions, "version_id").groupBy("memory_id").agg(F.count("*").alias("n_versions"), F.max("transaction_time").alias("last_transaction"))
    out = one_of_copies(lineages, "memory_id").select("memory_id", "tenant_id", "predicate", "lifecycle_state").join(last, "memory_id", "left").join(status_counts(state), "memory_id", "left")
    return out.fillna(0, ["n_versions", "n_current", "n_historical", "n_conflicted", "n_invalidated"])


def sequence_violations(versions: DataFrame) -> DataFrame:
    """Versions whose number is not one more than the one before (1 for the first) within their lineage."""
    w = Window.partitionBy("tenant_id", "memory_id").orderBy("version_number", "version_id")
    v = one_of_copies(versions, "version_id").withColumn("expected", F.row_number().over(w).cast("bigint"))
    return v.where(~F.col("version_number").eqNullSafe(F.col("expected"))).select("memory_id", "version_id", "version_number", "expected")


def chain_violations(log: DataFrame) -> DataFrame:
    """Changes that do not start from the status in which the one before left the version."""
    w = Window.partitionBy("tenant_id", "memory_id", "version_id").orderBy("sequence", "ordinal")
    seen = log.withColumn("before", F.lag("to_status").over(w))
    return seen.where(~F.col("from_status").eqNullSafe(F.col("before"))).select("version_id", "sequence", "from_status", "before")


def projection_lag(log: DataFrame, projection: DataFrame) -> DataFrame:
    """Per lineage how far the search projection is behind the log, in milliseconds; null if it has none."""
    newest = log.groupBy("memory_id").agg(F.max("occurred_at").alias("written"))
    shown = projection.groupBy("memory_id").agg(F.max("recorded_at").alias("projected"))
    ms = (F.unix_micros(F.col("written").cast("timestamp")) - F.unix_micros(F.col("projected").cast("timestamp"))) / 1000
    return newest.join(shown, "memory_id", "left").select("memory_id", F.bround(ms, 3).alias("lag_ms"))
