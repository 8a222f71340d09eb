"""Queries of the general problems 2 and 3, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.operators.late_events import daily_counts, hourly_counts, late_events
from mnemoframe.operators.orphan_references import memory_orphans, orphans
from mnemoframe.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = ("source_event", "memory_candidate", "memory_lineage", "memory_version", "memory_search_projection", "candidate_policy_decision", "erasure_tombstone")
    return memory_orphans(*(table(spark, folder, n) for n in names))


def p2_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field, kind and month."""
    return p2_found(spark, folder).groupBy("table_name", "field_name", "orphan_kind", "ref_month").agg(F.count("*").alias("n_refs"))


def p2_number_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans among sequential keys, whose parents make few runs: embeddings without their document, and lines without their order."""
    parts = (("embeddings", "vec_id", "documents", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))
    none = F.lit(None)
    refs = [
        table(spark, folder, t, c).select(F.lit(t).alias("table_name"), F.lit(c).alias("field_name"), F.col(c).cast("string").alias("record_id"), none.cast("string").alias("tenant_id"), F.lit(target).alias("target"), F.col(c).cast("string").alias("ref_key"), none.cast("bigint").alias("referred"))
        for t, c, target, _ in parts
    ]
    known = [table(spark, folder, target, key).select(none.cast("string").alias("tenant_id"), F.col(key).cast("string").alias("ref_key"), none.cast("bigint").alias("arrived"), F.lit(False).alias("erased"), F.lit(target).alias("target")) for _, _, target, key in parts]
    return orphans([r.where("ref_key IS NOT NULL") for r in refs], [k.where("ref_key IS NOT NULL") for k in known]).select("table_name", "field_name", "ref_key", "orphan_kind")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_events(table(spark, folder, "source_event"))


def p3_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per hour of occurred_at: at first close, corrected, final, and set apart."""
    return hourly_counts(table(spark, folder, "source_event"))


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The same per day, from the partials of the tree's inner nodes."""
    return daily_counts(table(spark, folder, "source_event"))


QUERIES = {"p2_found": p2_found, "p2_monthly": p2_monthly, "p2_number_keys": p2_number_keys, "p3_found": p3_found, "p3_hourly": p3_hourly, "p3_daily": p3_daily}

_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"
_ORPHANS = f"""
WITH refs AS (
  SELECT 'memory_search_projection' AS table_name, 'source_event_ids' AS field_name, version_id AS record_id, tenant_id, 'source_event' AS target,
         unnest(source_event_ids) AS raw, projected_at AS referred FROM memory_search_projection
  UNION ALL SELECT 'erasure_tombstone', 'object_id', deletion_operation_id, tenant_id,
         CASE object_type WHEN 'SOURCE_EVENT' THEN 'source_event_any' ELSE 'memory_lineage' END, object_id, erased_at
         FROM erasure_tombstone WHERE object_type IN ('SOURCE_EVENT', 'MEMORY_LINEAGE')
  UNION ALL SELECT 'memory_version', 'candidate_id', version_id, tenant_id, 'memory_candidate', candidate_id, transaction_time FROM memory_version
  UNION ALL SELECT 'candidate_policy_decision', 'candidate_id', decision_id, tenant_id, 'memory_candidate', candidate_id, decided_at FROM candidate_policy_decision),
keyed AS (SELECT *, lower(trim(raw, {_SPACE})) AS ref_key FROM refs),
known AS (
  SELECT 'source_event' AS target, tenant_id, lower(trim(source_event_id, {_SPACE})) AS k, min(received_at) AS arrived, bool_or(deletion_state = 'ERASED') AS erased FROM source_event GROUP BY ALL
  UNION ALL SELECT 'source_event_any', tenant_id, lower(trim(source_event_id, {_SPACE})), min(received_at), false FROM source_event GROUP BY ALL
  UNION ALL SELECT 'memory_lineage', tenant_id, lower(trim(memory_id, {_SPACE})), min(created_at), false FROM memory_lineage GROUP BY ALL
  UNION ALL SELECT 'memory_candidate', tenant_id, lower(trim(candidate_id, {_SPACE})), min(created_at), bool_or(content_state = 'ERASED') FROM memory_candidate GROUP BY ALL),
found AS (
  SELECT DISTINCT table_name, field_name, record_id, ref_key,
         CASE WHEN k IS NULL THEN 'missing' WHEN erased THEN 'deleted' WHEN arrived > referred THEN 'late' END AS orphan_kind,
         strftime(referred, '%Y-%m') AS ref_month
  FROM keyed r LEFT JOIN known n ON r.target = n.target AND r.tenant_id IS NOT DISTINCT FROM n.tenant_id AND r.ref_key = n.k
  WHERE ref_key IS NOT NULL AND ref_key <> '')
"""
_LATE = """
WITH first AS (SELECT source_event_id, min(occurred_at) AS occurred, min(received_at) AS arrived FROM source_event WHERE source_event_id IS NOT NULL GROUP BY ALL),
timed AS (SELECT source_event_id, strftime(date_trunc('hour', occurred), '%Y-%m-%d %H:00') AS event_hour, arrived, date_trunc('hour', occurred) + INTERVAL 1 HOUR AS closed
          FROM first WHERE occurred IS NOT NULL AND arrived IS NOT NULL),
judged AS (SELECT source_event_id, event_hour, CASE WHEN arrived > closed + INTERVAL 48 HOUR THEN 'dropped' WHEN arrived > closed + INTERVAL 15 MINUTE THEN 'corrected' END AS outcome FROM timed)
"""
SQL = {
    "p2_found": _ORPHANS + "SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p2_monthly": _ORPHANS + "SELECT table_name, field_name, orphan_kind, ref_month, count(*)::BIGINT AS n_refs FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL",
    "p2_number_keys": """SELECT DISTINCT 'embeddings' AS table_name, 'vec_id' AS field_name, vec_id::VARCHAR AS ref_key, 'missing' AS orphan_kind FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT DISTINCT 'lineitem', 'l_orderkey', l_orderkey::VARCHAR, 'missing' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)""",
    "p3_found": _LATE + "SELECT * FROM judged WHERE outcome IS NOT NULL",
    "p3_daily": _LATE
    + """SELECT event_hour[1:10] AS event_day, count(*) FILTER (outcome IS NULL)::BIGINT AS n_first, count(*) FILTER (outcome = 'corrected')::BIGINT AS n_corrected,
         count(*) FILTER (outcome IS DISTINCT FROM 'dropped')::BIGINT AS n_final, count(*) FILTER (outcome = 'dropped')::BIGINT AS n_dropped FROM judged GROUP BY ALL""",
    "p3_hourly": _LATE
    + """SELECT event_hour, count(*) FILTER (outcome IS NULL)::BIGINT AS n_first, count(*) FILTER (outcome = 'corrected')::BIGINT AS n_corrected,
         count(*) FILTER (outcome IS DISTINCT FROM 'dropped')::BIGINT AS n_final, count(*) FILTER (outcome = 'dropped')::BIGINT AS n_dropped FROM judged GROUP BY ALL""",
}
