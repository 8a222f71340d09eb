"""Commands on versions: corrections and invalidations, and receipts of repeated mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoframe.functions.hashing import length_prefixed, name_uuid


def apply_commands(commands: DataFrame, state: DataFrame) -> DataFrame:
    """The outcome of each command (command_id, version_id, kind, at) against the state (version_id, status).

    Of several commands on a version the first (by time, then id) applies: the version becomes INVALIDATED, and with CORRECT a replacement takes
    over its status under an id derived from the command's. Later ones find it invalidated; a null or unknown version is not found.
    The first per version is a partial aggregate, so a version with very many commands stays no group of its own.
    """
    first = commands.where(F.col("version_id").isNotNull()).groupBy("version_id").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "command_id")).alias("f"))
    rows = commands.join(first, "version_id", "left").join(state.select("version_id", "status"), "version_id", "left")
    alive = F.col("status").isNotNull() & (F.col("status") != "INVALIDATED")
    applies = alive & (F.col("command_id") == F.col("f.command_id"))
    outcome = F.when(F.col("status").isNull(), "NOT_FOUND").when(applies, "APPLIED").otherwise("ALREADY_INVALIDATED")
    corrected = applies & (F.col("kind") == "CORRECT")
    return rows.select("command_id", "version_id", "kind", outcome.alias("outcome"), F.when(applies, F.col("status")).alias("from_status"), F.when(corrected, name_uuid(F.col("command_id"))).alias("replacement_id"))


def receipts(mutations: DataFrame, key: tuple[str, ...], fields: tuple[str, ...], receipt: str, at: str) -> DataFrame:
    """Per mutation whether it is the first of its key (APPLIED), says the same again (IDEMPOTENT_REPLAY) or something else (CONFLICT), and the first one's receipt.

    The first is that of the least time, then receipt; a replay carries its receipt, a conflict none.
    """
    m = mutations.select(*key, receipt, F.col(at).alias("at"), length_prefixed(*(F.col(c) for c in fields)).alias("print"))
    first = m.groupBy(*key).agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", receipt, "print")).alias("f"))
    j = m.join(first, list(key))
    same = F.col("print") == F.col("f.print")
    is_first = F.col("at").eqNullSafe(F.col("f.at")) & (F.col(receipt) == F.col(f"f.{receipt}")) & same
    kind = F.when(is_first, "APPLIED").when(same, "IDEMPOTENT_REPLAY").otherwise("CONFLICT")
    return j.select(*key, receipt, kind.alias("disposition"), F.when(same, F.col(f"f.{receipt}")).alias("first_receipt"))


def merged_state(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The stored state (tenant_id, memory_id, version_id, sequence, ordinal, status, since) with newer log rows merged in: one row per version.

    Only the changed rows and the stored ones meet, the log behind the state is not read.
    """
    new = delta.select("tenant_id", "memory_id", "version_id", "sequence", "ordinal", F.col("to_status").alias("status"), F.col("occurred_at").alias("since"))
    last = F.max(F.struct("sequence", "ordinal", "status", "since"))
    return stored.unionByName(new).groupBy("tenant_id", "memory_id", "version_id").agg(last.alias("l")).select("tenant_id", "memory_id", "version_id", "l.*")
