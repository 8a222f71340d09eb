"""References to records that do not exist (problem 2).

A key becomes a block and an integer by its own characters. The parents' integers of a block are compressed into contiguous runs;
a reference is matched as-of to the run that starts before it and is missing beyond that run's end. A run also holds the bounds of its
parents' arrivals and whether some or all are erased, which settles most references; only those it leaves open are joined to parents.
Keys are distinct before they are shuffled, so hot ones collapse; kinds come back to the references by a join that adaptive
execution splits where it is skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from mnemoframe.functions.text import trimmed_key
from mnemoframe.functions.time import micros

REFERENCES = (("table_name", "string"), ("field_name", "string"), ("record_id", "string"), ("tenant_id", "string"), ("target", "string"), ("ref_key", "string"), ("referred", "bigint"))


def references(table_name: str, df: DataFrame, field: str, record_id: str, at: str, target: F.Column) -> DataFrame:
    """The non-blank references of one field; arrays are exploded. A null or blank entry is no reference."""
    value = F.explode(field) if dict(df.dtypes)[field].startswith("array") else F.col(field)
    picked = df.select(F.col(record_id).alias("record_id"), "tenant_id", target.alias("target"), value.alias("ref_key"), micros(F.col(at)).alias("referred"))
    return picked.select(F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), "record_id", "tenant_id", "target", trimmed_key(F.col("ref_key")).alias("ref_key"), "referred").where(F.col("ref_key").isNotNull())


def parents(df: DataFrame, target: str, key: str, arrived: str, erased: F.Column) -> DataFrame:
    """Rows (target, tenant_id, ref_key, arrived, erased) of the possible parents, copies included; those without a key are left out."""
    rows = df.select("tenant_id", trimmed_key(F.col(key)).alias("ref_key"), micros(F.col(arrived)).alias("arrived"), F.coalesce(erased, F.lit(False)).alias("erased"))
    return rows.where(F.col("ref_key").isNotNull()).withColumn("target", F.lit(target))


BLOCK = 1 << 16
KEY = ("target", "tenant_id", "block", "n")


def numbered(df: DataFrame, base: int = 10) -> DataFrame:
    """``ref_key`` as ``block`` and ``n`` < 65,536, one to one: neighbours in number are neighbours in a block.

    The key's last digits count, 18 decimal ones at most, or 12 hexadecimal ones as of a UUID (``base`` 16); without any the number
    is 0. What is before them, and how many they are, belong to the block. Neither column is ever null.
    """
    digits = F.regexp_extract("ref_key", r"([0-9a-f]{1,12})\z" if base == 16 else r"([0-9]{1,18})\z", 1)
    split = df.withColumn("_d", digits).withColumn("_n", F.coalesce((F.conv("_d", 16, 10) if base == 16 else F.col("_d")).try_cast("long"), F.lit(0)))
    block = F.concat_ws("/", F.left("ref_key", F.length("ref_key") - F.length("_d")), F.length("_d").cast("string"), F.shiftright("_n", 16).cast("string"))
    return split.withColumns({"block": block, "n": F.coalesce(F.col("_n").bitwiseAND(BLOCK - 1).cast("int"), F.lit(0))}).drop("_d", "_n")


def runs(known: DataFrame) -> DataFrame:
    """Rows (target, tenant_id, block, first, last, erasure, arrival bounds) of contiguous integers, from one row per parent."""
    order = Window.partitionBy("target", "tenant_id", "block").orderBy("n")
    island = known.withColumn("island", F.col("n") - F.row_number().over(order))
    return island.groupBy("target", "tenant_id", "block", "island").agg(
        F.min("n").alias("first"), F.max("n").alias("last"), F.bool_or("erased").alias("some_erased"), F.bool_and("erased").alias("all_erased"),
        F.min("arrived").alias("earliest_arrival"), F.max("arrived").alias("latest_arrival"), F.count("*").alias("n_parents"),
    ).drop("island")


def match_runs(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct references (target, tenant_id, block, n, ...), each with the run that starts at it or before it in ``run``, null if none does.

    A null tenant equals a null tenant. A reference beyond ``run.last`` has no parent.
    """
    types, extra = dict(keys.dtypes), [c for c in keys.columns if c not in KEY]
    held = F.struct("first", "last", "some_erased", "all_erased", "earliest_arrival", "latest_arrival", "n_parents")
    starts = table.select("target", "tenant_id", "block", F.col("first").alias("n"), F.lit(0).alias("is_ref"), held.alias("run"), *(F.lit(None).cast(types[c]).alias(c) for c in extra))
    asked = keys.select(*KEY, F.lit(1).alias("is_ref"), F.lit(None).cast(starts.schema["run"].dataType).alias("run"), *extra)
    upto = Window.partitionBy("target", "tenant_id", "block").orderBy("n", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("run", F.last("run", True).over(upto)).where("is_ref = 1").drop("is_ref")


def judge(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Of distinct references with the span of their referring times, those that may be orphans: adds found, erased and arrived.

    ``known``: one row per parent with arrived and erased. What a run of one parent or its bounds settle needs no parent any more.
    """
    matched = match_runs(keys, runs(known))
    inside, run = F.coalesce(F.col("n") <= F.col("run.last"), F.lit(False)), F.col("run")
    late = lambda arrived: F.coalesce(arrived > F.col("earliest"), F.lit(False))
    possible = matched.withColumn("found", inside).where(~F.col("found") | run["some_erased"] | late(run["latest_arrival"]))
    exact = ~F.col("found") | (run["n_parents"] == 1) | run["all_erased"]
    r, k = possible.withColumn("exact", exact).alias("r"), known.alias("k")
    same = (F.col("r.target") == F.col("k.target")) & F.col("r.tenant_id").eqNullSafe(F.col("k.tenant_id")) & (F.col("r.block") == F.col("k.block")) & (F.col("r.n") == F.col("k.n"))
    of = lambda bound, own: F.when(F.col("found"), F.when(F.col("exact"), F.col(f"run.{bound}")).otherwise(F.col(f"k.{own}"))).alias(own)
    judged = r.join(k, same & ~F.col("r.exact"), "left").select(*(F.col(f"r.{c}") for c in KEY), "earliest", "found", of("some_erased", "erased"), of("earliest_arrival", "arrived"))
    return judged.where(~F.col("found") | F.col("erased") | late(F.col("arrived"))).drop("earliest")


def orphans(refs: list[DataFrame], known: list[DataFrame], base: int = 10) -> DataFrame:
    """Orphan references with their kind and month: missing, else deleted, else late. Copies come out once."""
    every = numbered(reduce(DataFrame.unionByName, refs), base)
    distinct = every.groupBy(*KEY).agg(F.min("referred").alias("earliest"))
    parents_ = numbered(reduce(DataFrame.unionByName, known), base).groupBy(*KEY).agg(F.min("arrived").alias("arrived"), F.max("erased").alias("erased"))
    j = judge(distinct, parents_).alias("j")
    r = every.alias("r")
    same = (F.col("r.target") == F.col("j.target")) & (F.col("r.block") == F.col("j.block")) & (F.col("r.n") == F.col("j.n")) & F.col("r.tenant_id").eqNullSafe(F.col("j.tenant_id"))
    kind = F.when(~F.col("found"), "missing").when(F.col("erased"), "deleted").when(F.col("arrived") > F.col("referred"), "late")
    return (
        r.join(j, same)
        .select("table_name", "field_name", "record_id", F.col("r.ref_key").alias("ref_key"), kind.alias("orphan_kind"), F.date_format(F.timestamp_micros("referred"), "yyyy-MM").alias("ref_month"))
        .where(F.col("orphan_kind").isNotNull())
        .distinct()
    )


def memory_orphans(source_event: DataFrame, candidate: DataFrame, lineage: DataFrame, version: DataFrame, projection: DataFrame, decision: DataFrame, tombstone: DataFrame) -> DataFrame:
    """The reference fields of the memory tables. Targets of object_id are never reported as deleted."""
    of = F.col("object_type")
    refs = [
        references("memory_search_projection", projection, "source_event_ids", "version_id", "projected_at", F.lit("source_event")),
        references("erasure_tombstone", tombstone, "object_id", "deletion_operation_id", "erased_at", F.when(of == "SOURCE_EVENT", "source_event_any").when(of == "MEMORY_LINEAGE", "memory_lineage")).where(F.col("target").isNotNull()),
        references("memory_version", version, "candidate_id", "version_id", "transaction_time", F.lit("memory_candidate")),
        references("candidate_policy_decision", decision, "candidate_id", "decision_id", "decided_at", F.lit("memory_candidate")),
    ]
    events = parents(source_event, "source_event", "source_event_id", "received_at", F.col("deletion_state") == "ERASED")
    # one scan of the events serves both targets: the second takes no notice of erasure
    both = events.withColumn("target", F.explode(F.array(F.lit("source_event"), F.lit("source_event_any")))).withColumn("erased", F.col("erased") & (F.col("target") == "source_event"))
    known = [both, parents(lineage, "memory_lineage", "memory_id", "created_at", F.lit(False)), parents(candidate, "memory_candidate", "candidate_id", "created_at", F.col("content_state") == "ERASED")]
    return orphans(refs, known, 16)
