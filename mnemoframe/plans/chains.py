"""Chains over several relations: provenance, run states, ingest outcomes and the rebuilt projection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.functions.text import trimmed_key
from mnemoframe.operators import history as H
from mnemoframe.operators.ingest import fingerprint
from mnemoframe.operators.relational import one_of_copies
from mnemoframe.plans import assessment as A
from mnemoframe.plans.family import Family
from mnemoframe.plans.history import log
from mnemoframe.plans.records import _PRINT
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL
_SPACE = A._SPACE


@family.query(f"""WITH v AS (SELECT DISTINCT ON (version_id) tenant_id, memory_id, version_id, lower(trim(candidate_id, {_SPACE})) AS k FROM memory_version WHERE version_id IS NOT NULL AND trim(candidate_id, {_SPACE}) <> ''),
l AS (SELECT tenant_id, memory_id, min(predicate) AS predicate FROM memory_lineage GROUP BY 1, 2), c AS (SELECT DISTINCT ON (candidate_id) tenant_id, candidate_id, run_id, source_event_id FROM memory_candidate WHERE candidate_id IS NOT NULL),
e AS (SELECT tenant_id, source_event_id, min(received_at) AS received_at FROM source_event GROUP BY 1, 2),
d AS (SELECT tenant_id, k, max_by(decision, (decided_at, decision_id)) AS decision FROM (SELECT DISTINCT ON (decision_id) tenant_id, lower(trim(candidate_id, {_SPACE})) AS k, decision, decided_at, decision_id FROM candidate_policy_decision WHERE decision_id IS NOT NULL) WHERE k <> '' GROUP BY 1, 2)
SELECT v.version_id, v.memory_id, l.predicate, c.candidate_id, c.run_id, c.source_event_id, e.received_at, d.decision FROM v JOIN l USING (tenant_id, memory_id) JOIN c ON c.tenant_id = v.tenant_id AND c.candidate_id = v.k
JOIN e ON e.tenant_id = c.tenant_id AND e.source_event_id = c.source_event_id JOIN d ON d.tenant_id = c.tenant_id AND d.k = c.candidate_id""")
def provenance_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Version, lineage, candidate, event and latest decision: five relations, each reduced to its join key first."""
    v = one_of_copies(table(spark, folder, "memory_version", "tenant_id", "memory_id", "version_id", "candidate_id"), "version_id").withColumn("candidate_id", trimmed_key(F.col("candidate_id"))).where("candidate_id IS NOT NULL")
    lineages = table(spark, folder, "memory_lineage").groupBy("tenant_id", "memory_id").agg(F.min("predicate").alias("predicate"))
    c = one_of_copies(table(spark, folder, "memory_candidate", "tenant_id", "candidate_id", "run_id", "source_event_id"), "candidate_id")
    e = table(spark, folder, "source_event").groupBy("tenant_id", "source_event_id").agg(F.min("received_at").alias("received_at"))
    d = one_of_copies(table(spark, folder, "candidate_policy_decision", "tenant_id", "candidate_id", "decision_id", "decision", "decided_at"), "decision_id").withColumn("candidate_id", trimmed_key(F.col("candidate_id")))
    d = d.where("candidate_id IS NOT NULL").groupBy("tenant_id", "candidate_id").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("decision"))
    chain = v.join(lineages, ["tenant_id", "memory_id"]).join(c, ["tenant_id", "candidate_id"]).join(d, ["tenant_id", "candidate_id"]).join(e, ["tenant_id", "source_event_id"])
    return chain.select("version_id", "memory_id", "predicate", "candidate_id", "run_id", "source_event_id", "received_at", "decision")


@family.query(f"""WITH c AS (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL), d AS (SELECT DISTINCT tenant_id, lower(trim(candidate_id, {_SPACE})) AS k, true AS decided FROM candidate_policy_decision WHERE trim(candidate_id, {_SPACE}) <> '')
SELECT run_id, count(*)::BIGINT AS n, count(decided)::BIGINT AS n_decided, CASE WHEN bool_or(content_state = 'ERASED') THEN 'FAILED' WHEN count(decided) = count(*) THEN 'SUCCEEDED' ELSE 'PENDING' END AS state,
coalesce(sum(length(normalized_content)), 0)::BIGINT AS n_tokens, coalesce(sum(length(normalized_content)) FILTER (decided), 0)::BIGINT AS n_decided_tokens, coalesce(bool_and(content_state = 'AVAILABLE' AND decided IS NOT NULL), false) AS complete
FROM c LEFT JOIN d ON c.tenant_id = d.tenant_id AND c.candidate_id = d.k GROUP BY 1""")
def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """A run's state from its parts: one erased part fails it, all decided ones make it succeed; token sums, and whether the sums are complete."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "tenant_id", "run_id", "content_state", "normalized_content"), "candidate_id")
    d = table(spark, folder, "candidate_policy_decision").select("tenant_id", trimmed_key(F.col("candidate_id")).alias("candidate_id")).where("candidate_id IS NOT NULL").distinct().withColumn("decided", F.lit(True))
    n, tokens, decided = F.count("*"), F.length("normalized_content"), F.count("decided")
    return c.join(d, ["tenant_id", "candidate_id"], "left").groupBy("run_id").agg(
        n.alias("n"), decided.alias("n_decided"), F.when(F.bool_or(F.col("content_state") == "ERASED"), "FAILED").when(decided == n, "SUCCEEDED").otherwise("PENDING").alias("state"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("decided"), tokens)), F.lit(0)).alias("n_decided_tokens"),
        F.coalesce(F.bool_and((F.col("content_state") == "AVAILABLE") & F.col("decided").isNotNull()), F.lit(False)).alias("complete"),
    )


@family.query(f"""WITH t AS (SELECT DISTINCT tenant_id, lower(trim(object_id, {_SPACE})) AS k, true AS gone FROM erasure_tombstone WHERE object_type = 'SOURCE_EVENT'),
a AS (SELECT tenant_id, idempotency_key, source_id, source_event_id, received_at, {_PRINT} AS p, lower(trim(source_event_id, {_SPACE})) AS k FROM source_event),
f AS (SELECT tenant_id, idempotency_key, min((received_at, source_event_id)) AS o, arg_min(p, (received_at, source_event_id)) AS fp FROM a GROUP BY 1, 2),
s AS (SELECT tenant_id, source_id, min((received_at, idempotency_key)) AS so FROM a WHERE source_id IS NOT NULL GROUP BY 1, 2)
SELECT source_event_id, received_at, CASE WHEN gone THEN 'ERASED_SCOPE' WHEN p <> fp THEN 'CONFLICT' WHEN (received_at, source_event_id) > o THEN 'IDEMPOTENT_REPLAY' WHEN so IS NOT NULL AND struct_extract(so, 2) <> idempotency_key THEN 'DUPLICATE_SOURCE' ELSE 'ACCEPTED' END AS outcome
FROM a JOIN f USING (tenant_id, idempotency_key) LEFT JOIN s USING (tenant_id, source_id) LEFT JOIN t ON t.tenant_id = a.tenant_id AND t.k = a.k""")
def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals in the order of the checks: erased before, key seen with other or the same content, source seen under another key, else accepted."""
    gone = table(spark, folder, "erasure_tombstone").where("object_type = 'SOURCE_EVENT'").select("tenant_id", trimmed_key(F.col("object_id")).alias("k")).where("k IS NOT NULL").distinct().withColumn("gone", F.lit(True))
    a = table(spark, folder, "source_event").select("tenant_id", "idempotency_key", "source_id", "source_event_id", "received_at", fingerprint().alias("p"), trimmed_key(F.col("source_event_id")).alias("k"))
    order = F.struct("received_at", "source_event_id")
    first = a.groupBy("tenant_id", "idempotency_key").agg(F.min(F.struct(order.alias("o"), "p")).alias("f"))
    by_source = a.where("source_id IS NOT NULL").groupBy("tenant_id", "source_id").agg(F.min(F.struct("received_at", "idempotency_key")).alias("s"))
    j = a.join(first, ["tenant_id", "idempotency_key"]).join(by_source, ["tenant_id", "source_id"], "left").join(gone, ["tenant_id", "k"], "left")
    outcome = (
        F.when(F.col("gone"), "ERASED_SCOPE").when(F.col("p") != F.col("f.p"), "CONFLICT").when(order > F.col("f.o"), "IDEMPOTENT_REPLAY")
        .when(F.col("s").isNotNull() & (F.col("s.idempotency_key") != F.col("idempotency_key")), "DUPLICATE_SOURCE").otherwise("ACCEPTED")
    )
    return j.select("source_event_id", "received_at", outcome.alias("outcome"))


@family.query(A.SQL["correction_outcomes"].rpartition("SELECT command_id, c.version_id")[0] + """, gone AS (SELECT DISTINCT c.version_id FROM c JOIN state USING (version_id) WHERE r = 1),
a AS (SELECT DISTINCT tenant_id, memory_id FROM memory_lineage WHERE lifecycle_state = 'ACTIVE'), e AS (SELECT tenant_id, source_event_id FROM source_event GROUP BY 1, 2 HAVING NOT bool_or(deletion_state = 'ERASED')),
s AS (SELECT t.version_id, list(DISTINCT e.source_event_id ORDER BY e.source_event_id) AS sources FROM t JOIN (SELECT DISTINCT tenant_id, candidate_id, source_event_id FROM memory_candidate) m ON m.candidate_id = t.k JOIN e ON e.tenant_id = m.tenant_id AND e.source_event_id = m.source_event_id GROUP BY 1)
SELECT v.version_id, v.memory_id, status, coalesce(sources, []) AS sources FROM v JOIN a USING (tenant_id, memory_id) JOIN state USING (version_id) LEFT JOIN s USING (version_id) WHERE content_state = 'AVAILABLE' AND v.version_id NOT IN (FROM gone)""")
def projection_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The projection with the latest status: active lineages, available versions that no command invalidated, sources that still stand."""
    v = one_of_copies(table(spark, folder, "memory_version", "version_id", "tenant_id", "memory_id", "candidate_id", "content_state"), "version_id")
    active = table(spark, folder, "memory_lineage").where("lifecycle_state = 'ACTIVE'").select("tenant_id", "memory_id").distinct()
    state = H.current_state(log(spark, folder)).select("version_id", "status")
    gone = A.correction_outcomes(spark, folder).where("outcome = 'APPLIED'").select("version_id")
    alive = table(spark, folder, "source_event").groupBy("tenant_id", "source_event_id").agg(F.bool_or(F.coalesce(F.col("deletion_state") == "ERASED", F.lit(False))).alias("x")).where("NOT x").drop("x")
    c = table(spark, folder, "memory_candidate", "tenant_id", "candidate_id", "source_event_id").distinct().join(alive, ["tenant_id", "source_event_id"]).select("candidate_id", "source_event_id")
    keyed = v.select("version_id", trimmed_key(F.col("candidate_id")).alias("candidate_id")).where("candidate_id IS NOT NULL")
    sources = keyed.join(c, "candidate_id").groupBy("version_id").agg(F.array_sort(F.collect_set("source_event_id")).alias("sources"))
    kept = v.where("content_state = 'AVAILABLE'").join(active, ["tenant_id", "memory_id"], "left_semi").join(state, "version_id").join(gone, "version_id", "left_anti").join(sources, "version_id", "left")
    return kept.select("version_id", "memory_id", "status", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
