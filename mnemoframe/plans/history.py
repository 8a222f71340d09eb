"""History and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.operators import history as H, lineage as L
from mnemoframe.operators.relational import keyset_page, latest_per_key, one_of_copies, optional
from mnemoframe.plans.family import Family
from mnemoframe.scope import Scope
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL

LOG = """WITH v AS (SELECT DISTINCT ON (version_id) * FROM memory_version WHERE version_id IS NOT NULL),
l AS (SELECT DISTINCT ON (memory_id) * FROM memory_lineage WHERE memory_id IS NOT NULL),
o AS (SELECT v.tenant_id, v.memory_id, version_id, version_number, transaction_time, predicate_cardinality,
      lead(version_number) OVER w AS next_n, lead(transaction_time) OVER w AS next_at FROM v JOIN l ON v.tenant_id = l.tenant_id AND v.memory_id = l.memory_id
      WINDOW w AS (PARTITION BY v.tenant_id, v.memory_id ORDER BY version_number, version_id)),
log AS (SELECT tenant_id, memory_id, version_id, version_number AS sequence, 0 AS ordinal, NULL AS from_status, 'CURRENT' AS to_status, transaction_time AS occurred_at FROM o
        UNION ALL SELECT tenant_id, memory_id, version_id, next_n, 1, 'CURRENT', 'HISTORICAL', next_at FROM o WHERE predicate_cardinality = 'SINGLE' AND next_n IS NOT NULL),
state AS (SELECT tenant_id, memory_id, version_id, to_status AS status, occurred_at AS since FROM
          (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY sequence DESC, ordinal DESC) AS r FROM log) WHERE r = 1),
counts AS (SELECT memory_id, count(*) FILTER (status = 'CURRENT')::BIGINT AS n_current, count(*) FILTER (status = 'HISTORICAL')::BIGINT AS n_historical,
           count(*) FILTER (status = 'CONFLICTED')::BIGINT AS n_conflicted, count(*) FILTER (status = 'INVALIDATED')::BIGINT AS n_invalidated FROM state GROUP BY 1)
"""
AT, LATER = "2025-06-01 00:00:00", "2025-09-01 00:00:00"


def ntz(text: str) -> F.Column:
    return F.to_timestamp_ntz(F.lit(text))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return H.status_log(table(spark, folder, "memory_version"), table(spark, folder, "memory_lineage"))


@family.query(LOG + "SELECT * FROM state")
def current_state(spark: SparkSession, folder: str) -> DataFrame:
    return H.current_state(log(spark, folder))


@family.query(LOG + "SELECT * FROM state")
def current_state_incremental(spark: SparkSession, folder: str) -> DataFrame:
    return H.current_state_incremental(log(spark, folder))


@family.query(LOG + f"""SELECT tenant_id, memory_id, version_id, to_status AS status, occurred_at AS since FROM
  (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY sequence DESC, ordinal DESC) AS r FROM log WHERE occurred_at <= TIMESTAMP '{AT}') WHERE r = 1""")
def as_of_status(spark: SparkSession, folder: str) -> DataFrame:
    return H.as_of(log(spark, folder), ntz(AT))


@family.query(LOG + """, probes AS (SELECT DISTINCT candidate_id AS probe_id, memory_id, c.created_at AS probe_time FROM v JOIN
  (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate) c USING (candidate_id))
SELECT probe_id, memory_id, version_id, to_status AS status FROM (SELECT p.probe_id, p.memory_id, g.version_id, g.to_status,
  row_number() OVER (PARTITION BY p.probe_id, p.memory_id, g.version_id ORDER BY sequence DESC, ordinal DESC) AS r
  FROM log g JOIN probes p ON g.memory_id = p.memory_id AND g.occurred_at <= p.probe_time) WHERE r = 1""")
def as_of_probes(spark: SparkSession, folder: str) -> DataFrame:
    """As-of join: the statuses at the time each version's candidate was proposed."""
    v = one_of_copies(table(spark, folder, "memory_version", "version_id", "memory_id", "candidate_id"), "version_id")
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "created_at"), "candidate_id")
    probes = v.join(c, "candidate_id").select(F.col("candidate_id").alias("probe_id"), "memory_id", F.col("created_at").alias("probe_time")).distinct()
    return H.as_of_many(log(spark, folder), probes)


@family.query(LOG + f""", a AS (SELECT memory_id, version_id, max_by(to_status, sequence * 2 + ordinal) AS old_status FROM log WHERE occurred_at <= TIMESTAMP '{AT}' GROUP BY 1, 2),
b AS (SELECT memory_id, version_id, max_by(to_status, sequence * 2 + ordinal) AS new_status FROM log WHERE occurred_at <= TIMESTAMP '{LATER}' GROUP BY 1, 2)
SELECT b.memory_id, b.version_id, old_status, new_status FROM b LEFT JOIN a ON a.version_id = b.version_id AND a.memory_id = b.memory_id WHERE old_status IS DISTINCT FROM new_status""")
def diff_window(spark: SparkSession, folder: str) -> DataFrame:
    return H.diff(log(spark, folder), ntz(AT), ntz(LATER))


@family.query(LOG + "SELECT * FROM counts")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return H.status_counts(H.current_state(log(spark, folder)))


@family.query(LOG + """, n AS (SELECT memory_id, count(*)::BIGINT AS n_versions, max(transaction_time) AS last_transaction FROM v GROUP BY 1)
SELECT l.memory_id, l.tenant_id, l.predicate, l.lifecycle_state, coalesce(n_versions, 0)::BIGINT AS n_versions, last_transaction, coalesce(n_current, 0)::BIGINT AS n_current,
  coalesce(n_historical, 0)::BIGINT AS n_historical, coalesce(n_conflicted, 0)::BIGINT AS n_conflicted, coalesce(n_invalidated, 0)::BIGINT AS n_invalidated
FROM l LEFT JOIN n USING (memory_id) LEFT JOIN counts USING (memory_id)""")
def lineage_list(spark: SparkSession, folder: str) -> DataFrame:
    return H.lineage_list(table(spark, folder, "memory_lineage"), table(spark, folder, "memory_version"), H.current_state(log(spark, folder)))


@family.query("SELECT DISTINCT memory_id, predicate FROM memory_lineage WHERE memory_id > '4' ORDER BY memory_id LIMIT 51")
def lineage_page(spark: SparkSession, folder: str) -> DataFrame:
    """Keyset pagination: a page of 50 lineages and the row that starts the next."""
    return keyset_page(table(spark, folder, "memory_lineage", "memory_id", "predicate").distinct(), "memory_id", "4", 50)


@family.query(LOG + """SELECT memory_id, sequence, to_status, version_id FROM
  (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY sequence DESC, ordinal DESC, version_id) AS r FROM log) WHERE r = 1""")
def latest_transition(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(log(spark, folder), ["memory_id"], F.desc("sequence"), F.desc("ordinal"), F.asc("version_id")).select("memory_id", "sequence", "to_status", "version_id")


@family.query("""WITH v AS (SELECT DISTINCT ON (version_id) * FROM memory_version), c AS (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL),
e AS (SELECT source_event_id, min(received_at) AS received_at FROM source_event GROUP BY 1)
SELECT version_id, v.candidate_id, c.source_event_id, e.received_at FROM v LEFT JOIN c ON v.candidate_id = c.candidate_id LEFT JOIN e ON c.source_event_id = e.source_event_id""")
def version_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Version to candidate to event: a chain of equi-joins after each side has been reduced to its key."""
    v = one_of_copies(table(spark, folder, "memory_version", "version_id", "candidate_id"), "version_id")
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "source_event_id"), "candidate_id")
    e = table(spark, folder, "source_event").groupBy("source_event_id").agg(F.min("received_at").alias("received_at"))
    return v.join(c, "candidate_id", "left").join(e, "source_event_id", "left").select("version_id", "candidate_id", "source_event_id", "received_at")


@family.query("""WITH c AS (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL), d AS (SELECT DISTINCT ON (decision_id) * FROM candidate_policy_decision WHERE decision_id IS NOT NULL)
SELECT candidate_id, decision_id, decision, decided_at FROM (SELECT c.candidate_id, decision_id, decision, decided_at,
  row_number() OVER (PARTITION BY c.candidate_id ORDER BY decided_at DESC, decision_id) AS r FROM c JOIN d ON c.candidate_id = d.candidate_id AND c.tenant_id = d.tenant_id) WHERE r = 1""")
def best_decision(spark: SparkSession, folder: str) -> DataFrame:
    """The one best row of a lateral subquery: the latest decision of each candidate."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "tenant_id"), "candidate_id")
    d = one_of_copies(table(spark, folder, "candidate_policy_decision", "decision_id", "candidate_id", "tenant_id", "decision", "decided_at"), "decision_id")
    return latest_per_key(d.join(c, ["candidate_id", "tenant_id"]), ["candidate_id"], F.desc("decided_at"), F.asc("decision_id")).select("candidate_id", "decision_id", "decision", "decided_at")


@family.query(LOG + """SELECT memory_id, version_id, version_number, expected FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, memory_id ORDER BY version_number, version_id) AS expected FROM v)
WHERE version_number IS DISTINCT FROM expected""")
def sequence_violations(spark: SparkSession, folder: str) -> DataFrame:
    return H.sequence_violations(table(spark, folder, "memory_version"))


@family.query(LOG + """SELECT version_id, sequence, from_status, before FROM (SELECT *, lag(to_status) OVER (PARTITION BY version_id ORDER BY sequence, ordinal) AS before FROM log)
WHERE from_status IS DISTINCT FROM before""")
def chain_violations(spark: SparkSession, folder: str) -> DataFrame:
    return H.chain_violations(log(spark, folder))


@family.query(LOG + """SELECT memory_id, round_even((epoch_us(max(occurred_at)) - epoch_us(any_value(projected))) / 1000, 3) AS lag_ms FROM log
LEFT JOIN (SELECT memory_id, max(recorded_at) AS projected FROM memory_search_projection GROUP BY 1) USING (memory_id) GROUP BY 1""")
def projection_lag(spark: SparkSession, folder: str) -> DataFrame:
    return H.projection_lag(log(spark, folder), table(spark, folder, "memory_search_projection"))


@family.query("SELECT source_event_id, user_id, occurred_at, trust_level FROM source_event WHERE tenant_id = 'tn-harborlight' AND agent_id = 'agent-planner'")
def scope_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Scan with the mandatory scope: predicates and columns reach the reader."""
    return Scope("tn-harborlight", agent_id="agent-planner").apply(table(spark, folder, "source_event")).select("source_event_id", "user_id", "occurred_at", "trust_level")


@family.query("SELECT memory_id, predicate, lifecycle_state FROM memory_lineage WHERE predicate = 'habit.exercise' AND lifecycle_state = 'ACTIVE'")
def optional_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Optional predicates: those without a value leave no trace in the plan."""
    df = optional(table(spark, folder, "memory_lineage"), predicate="habit.exercise", lifecycle_state="ACTIVE", subject_label=None)
    return df.select("memory_id", "predicate", "lifecycle_state")


@family.query(f"""SELECT version_id, truth_status FROM memory_search_projection p WHERE (valid_time_start IS NULL OR valid_time_start <= TIMESTAMP '{AT}')
AND (valid_time_end IS NULL OR valid_time_end > TIMESTAMP '{AT}') AND truth_status IN ('CURRENT', 'CONFLICTED')
AND EXISTS (SELECT 1 FROM memory_lineage l WHERE l.memory_id = p.memory_id AND l.tenant_id = p.tenant_id AND lifecycle_state = 'ACTIVE')""")
def visible_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Present visibility: half-open validity, truth state, and a semi-join on active lineages."""
    from mnemoframe.functions.time import valid_at

    p = table(spark, folder, "memory_search_projection").where(valid_at(F.col("valid_time_start"), F.col("valid_time_end"), ntz(AT)) & F.col("truth_status").isin("CURRENT", "CONFLICTED"))
    active = table(spark, folder, "memory_lineage").where("lifecycle_state = 'ACTIVE'").select("memory_id", "tenant_id")
    return p.join(active, ["memory_id", "tenant_id"], "left_semi").select("version_id", "truth_status")


@family.query("""WITH v AS (SELECT DISTINCT ON (version_id) memory_id, version_id, version_number, valid_time_start AS s, valid_time_end AS e,
  coalesce(valid_time_precision <> 'UNKNOWN' AND confidence >= 0.8, false) AS k FROM memory_version)
SELECT a.memory_id, a.version_id, b.version_id AS earlier_version_id, CASE WHEN NOT a.k OR NOT b.k OR (a.s IS NULL AND a.e IS NULL) OR (b.s IS NULL AND b.e IS NULL) THEN 'INDETERMINATE'
  WHEN a.e <= b.s THEN 'BEFORE' WHEN a.s >= b.e THEN 'AFTER' WHEN a.s IS NOT NULL AND a.e IS NOT NULL AND b.s IS NOT NULL AND b.e IS NOT NULL THEN 'OVERLAPS' ELSE 'INDETERMINATE' END AS relation
FROM v a JOIN v b ON a.memory_id = b.memory_id AND b.version_number = (SELECT max(version_number) FROM v c WHERE c.memory_id = a.memory_id AND c.version_number < a.version_number)""")
def interval_relation(spark: SparkSession, folder: str) -> DataFrame:
    return L.version_relations(one_of_copies(table(spark, folder, "memory_version"), "version_id"))


@family.query(r"""WITH v AS (SELECT DISTINCT ON (version_id) memory_id, version_id, version_number, value_json, trim(regexp_replace(lower(coalesce(normalized_content, '')), '\s+', ' ', 'g')) AS content
  FROM memory_version WHERE value_json IS NOT NULL), f AS (SELECT DISTINCT ON (memory_id, value_json) memory_id, value_json, version_id AS fid, content AS fc FROM v ORDER BY memory_id, value_json, version_number, version_id)
SELECT memory_id, version_id, fid AS repeats_version_id, CASE WHEN content = fc THEN 'EXACT' ELSE 'PARAPHRASE' END AS assessment FROM v JOIN f USING (memory_id, value_json) WHERE version_id <> fid""")
def repeated_values(spark: SparkSession, folder: str) -> DataFrame:
    return L.duplicates(one_of_copies(table(spark, folder, "memory_version"), "version_id"))


_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"
_REL = """CASE WHEN NOT (x.k AND y.k) OR (x.s IS NULL AND x.e IS NULL) OR (y.s IS NULL AND y.e IS NULL) THEN 'I' WHEN x.e <= y.s THEN 'B' WHEN x.s >= y.e THEN 'A' WHEN x.s IS NOT NULL AND x.e IS NOT NULL AND y.s IS NOT NULL AND y.e IS NOT NULL THEN 'O' ELSE 'I' END"""


# a recursion over the place in the lineage: the retained versions before it, what happens, the retained versions after it
@family.query(f"""WITH RECURSIVE l AS (SELECT memory_id, min(predicate_cardinality) = 'SINGLE' AS single FROM memory_lineage GROUP BY 1),
v AS (SELECT memory_id, version_id, coalesce(single, false) AS single, value_json AS v, nullif(lower(trim(candidate_id, {_SPACE})), '') AS c, valid_time_start AS s, valid_time_end AS e, coalesce(valid_time_precision <> 'UNKNOWN' AND confidence >= 0.8, false) AS k,
  row_number() OVER (PARTITION BY memory_id ORDER BY version_number, version_id) AS n FROM (SELECT DISTINCT ON (version_id) * FROM memory_version WHERE version_id IS NOT NULL) JOIN l USING (memory_id)),
walk AS (
  SELECT memory_id, 0::BIGINT AS n, NULL::VARCHAR AS version_id, NULL::VARCHAR AS operation, NULL::VARCHAR AS subject_version_id, NULL::VARCHAR AS new_status, []::STRUCT(version_id VARCHAR, from_status VARCHAR, to_status VARCHAR)[] AS changes,
    []::STRUCT(id VARCHAR, v VARCHAR, s TIMESTAMP, e TIMESTAMP, k BOOLEAN, t VARCHAR)[] AS kept, []::VARCHAR[] AS seen FROM v WHERE n = 1
  UNION ALL
  SELECT memory_id, n, version_id, operation, CASE operation WHEN 'IGNORE' THEN NULL WHEN 'REINFORCE' THEN same ELSE version_id END, CASE WHEN operation NOT IN ('IGNORE', 'REINFORCE') THEN new_status END,
    list_sort(list_transform(list_filter(moved, lambda m: m.t <> m.was), lambda m: {{'version_id': m.id, 'from_status': m.was, 'to_status': m.t}})),
    CASE WHEN operation IN ('IGNORE', 'REINFORCE') THEN kept ELSE list_transform(moved, lambda m: {{'id': m.id, 'v': m.v, 's': m.s, 'e': m.e, 'k': m.k, 't': m.t}}) || [{{'id': version_id, 'v': v, 's': s, 'e': e, 'k': k, 't': new_status}}] END,
    CASE WHEN c IS NULL OR operation = 'IGNORE' THEN seen ELSE seen || [c] END
  FROM (SELECT *, CASE operation WHEN 'CONFLICT' THEN 'CONFLICTED' WHEN 'SUPERSEDE' THEN CASE WHEN list_contains(rel, 'B') THEN 'HISTORICAL' ELSE 'CURRENT' END ELSE 'CURRENT' END AS new_status,
      list_transform(kept, lambda y, i: {{'id': y.id, 'v': y.v, 's': y.s, 'e': y.e, 'k': y.k, 'was': y.t,
        't': CASE WHEN operation = 'CONFLICT' AND rel[i] IN ('O', 'I') THEN 'CONFLICTED' WHEN operation = 'SUPERSEDE' AND NOT list_contains(rel, 'B') THEN 'HISTORICAL' ELSE y.t END}}) AS moved
    FROM (SELECT *, CASE WHEN list_contains(seen, c) THEN 'IGNORE' WHEN same IS NOT NULL THEN 'REINFORCE' WHEN len(kept) = 0 THEN 'CREATE' WHEN NOT single THEN 'COEXIST' WHEN list_contains(rel, 'O') OR list_contains(rel, 'I') THEN 'CONFLICT' ELSE 'SUPERSEDE' END AS operation
      FROM (SELECT x.*, w.kept, w.seen, list_filter(w.kept, lambda y: y.v IS NOT DISTINCT FROM x.v)[1].id AS same, list_transform(w.kept, lambda y: {_REL}) AS rel FROM walk w JOIN v x ON w.memory_id = x.memory_id AND x.n = w.n + 1))))
SELECT memory_id, version_id, operation, subject_version_id, new_status, changes FROM walk WHERE n > 0""")
def lineage_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered fold of every lineage."""
    return L.fold(table(spark, folder, "memory_version"), table(spark, folder, "memory_lineage"))


@family.query("""WITH f AS (SELECT user_id || '/' || event_type AS lineage, value, min(event_id) AS n FROM events GROUP BY 1, 2),
s AS (SELECT f.lineage, f.n, f.value, ts AS s, ts + INTERVAL 12 HOUR AS e FROM f JOIN events ON n = event_id),
m AS (SELECT a.lineage, a.n, min(b.n) AS least, max(b.n) AS most FROM s a JOIN s b ON a.lineage = b.lineage AND a.n <> b.n AND a.s < b.e AND b.s < a.e GROUP BY 1, 2),
k AS (SELECT s.*, most, coalesce(least < s.n, false) AS conflict FROM s LEFT JOIN m ON s.lineage = m.lineage AND s.n = m.n),
last AS (SELECT lineage, max(n) AS last FROM k WHERE NOT conflict GROUP BY 1)
SELECT k.lineage, n, value, CASE WHEN n > last OR coalesce(most > last, false) THEN 'CONFLICTED' WHEN n = last THEN 'CURRENT' ELSE 'HISTORICAL' END AS status FROM k JOIN last ON k.lineage = last.lineage""")
def closed_form_status(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of single-valued lineages over the event stream, each assertion valid for 12 hours."""
    return asserted(table(spark, folder, "events"))


def asserted(e: DataFrame) -> DataFrame:
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("lineage"), F.col("event_id").alias("n"), "value", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("e"))
    return L.closed_form(rows)
