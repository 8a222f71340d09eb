"""Ingestion, erasure, evaluation, scalar and event-time queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.functions import hashing, text as T, udfs
from mnemoframe.operators import erasure as E, evaluation as V, ingest as I
from mnemoframe.operators.relational import one_of_copies, ratio, upsert_latest
from mnemoframe.plans.family import Family
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL

_BYTES = "unhex(lpad(to_hex(octet_length(encode(coalesce({0}, '')))), 8, '0')) || encode(coalesce({0}, ''))"
_PRINT = "sha256(" + " || ".join(_BYTES.format(c) for c in ("tenant_id", "user_id", "agent_id", "source_id", "payload")) + ")"


@family.query(f"""WITH a AS (SELECT tenant_id, idempotency_key, source_event_id, trace_id, received_at, {_PRINT} AS p FROM source_event),
f AS (SELECT DISTINCT ON (tenant_id, idempotency_key) tenant_id, idempotency_key, received_at AS fr, coalesce(trace_id, '') AS ft, p AS fp FROM a ORDER BY tenant_id, idempotency_key, received_at NULLS LAST, coalesce(trace_id, ''), p)
SELECT tenant_id, idempotency_key, source_event_id, trace_id, CASE WHEN received_at IS NOT DISTINCT FROM fr AND coalesce(trace_id, '') = ft THEN 'ACCEPTED' WHEN p = fp THEN 'IDEMPOTENT_REPLAY' ELSE 'CONFLICT' END AS disposition
FROM a JOIN f USING (tenant_id, idempotency_key)""")
def ingest_classify(spark: SparkSession, folder: str) -> DataFrame:
    return I.classify(table(spark, folder, "source_event"))


@family.query("""WITH known AS (SELECT DISTINCT tenant_id, idempotency_key FROM source_event WHERE received_at < TIMESTAMP '2025-06-01')
SELECT source_event_id, received_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY received_at NULLS LAST, trace_id NULLS LAST) AS r FROM source_event s
WHERE received_at >= TIMESTAMP '2025-06-01' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant_id = s.tenant_id AND k.idempotency_key = s.idempotency_key)) WHERE r = 1""")
def ingest_new(spark: SparkSession, folder: str) -> DataFrame:
    """Insert-or-ignore of a batch against what is known: anti-join on the natural key."""
    e, cut = table(spark, folder, "source_event"), F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00"))
    return I.new_arrivals(e.where(F.col("received_at") >= cut), e.where(F.col("received_at") < cut)).select("source_event_id", "received_at")


@family.query(f"SELECT DISTINCT source_event_id, {_PRINT} AS fingerprint FROM source_event")
def request_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_event").select("source_event_id", I.fingerprint().alias("fingerprint")).distinct()


@family.query("""SELECT DISTINCT candidate_id, sha256(tenant_id || chr(0) || coalesce(predicate, '') || chr(0) || coalesce(subject_label, '') || chr(0) || coalesce(value_json, '')) AS fingerprint FROM memory_candidate""")
def candidate_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "memory_candidate")
    return c.select("candidate_id", hashing.nul_joined(*(F.col(x) for x in ("tenant_id", "predicate", "subject_label", "value_json"))).alias("fingerprint")).distinct()


@family.query("""WITH h AS (SELECT DISTINCT memory_id, md5(tenant_id || '/' || memory_id) AS h FROM memory_lineage)
SELECT memory_id, h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS derived_id FROM h""")
def name_based_uuid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memory_lineage").select("memory_id", hashing.name_uuid(F.concat_ws("/", "tenant_id", "memory_id")).alias("derived_id")).distinct()


@family.query()
def normalise_text(spark: SparkSession, folder: str) -> DataFrame:
    """Case and white space of every document; null texts stay null."""
    return normalised(table(spark, folder, "documents"), T.squeeze(F.col("text"), T.ANY_SPACE))


def normalised(d: DataFrame, text: F.Column) -> DataFrame:
    return d.select("doc_id", text.alias("normalised"), F.length("text").alias("n_chars"))


@family.query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("escaped"))


@family.query(r"SELECT DISTINCT source_event_id, regexp_extract(payload, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS address FROM source_event WHERE regexp_matches(payload, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def plain_address(spark: SparkSession, folder: str) -> DataFrame:
    """A pattern predicate and extraction that stay in the JVM."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return table(spark, folder, "source_event").where(F.col("payload").rlike(pattern)).select("source_event_id", F.regexp_extract("payload", pattern, 0).alias("address")).distinct()


@family.query("""SELECT DISTINCT candidate_id, predicate, lower(trim(predicate)) AS proper, lower(trim(predicate)) IN (SELECT predicate FROM predicate_catalog) AS known,
regexp_matches(predicate, '^[a-z][a-z0-9_.-]{0,127}$') AS well_formed FROM memory_candidate WHERE trim(predicate) <> ''""")
def predicate_check(spark: SparkSession, folder: str) -> DataFrame:
    """Not-blank and shape checks, and membership in the catalog by a join to its few distinct entries."""
    known = table(spark, folder, "predicate_catalog").select(F.col("predicate").alias("proper")).distinct().withColumn("known", F.lit(True))
    c = table(spark, folder, "memory_candidate", "candidate_id", "predicate").where(F.trim("predicate") != "").distinct()
    return c.withColumn("proper", F.lower(F.trim("predicate"))).join(known, "proper", "left").select("candidate_id", "predicate", "proper", F.coalesce("known", F.lit(False)).alias("known"), F.col("predicate").rlike(r"^[a-z][a-z0-9_.-]{0,127}\z").alias("well_formed"))


@family.query("""SELECT DISTINCT candidate_id, try_cast(event_time_json->>'start' AS TIMESTAMP) AS started, (event_time_json->>'confidence')::DOUBLE AS confidence,
coalesce((event_time_json->>'confidence')::DOUBLE BETWEEN 0 AND 1, false) AS sound FROM memory_candidate WHERE event_time_json IS NOT NULL""")
def event_time_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of a JSON column by schema; a bad time becomes null."""
    c = table(spark, folder, "memory_candidate", "candidate_id", "event_time_json").where(F.col("event_time_json").isNotNull()).distinct()
    j = c.select("candidate_id", F.from_json("event_time_json", "start string, confidence double").alias("j"))
    start = F.try_to_timestamp(F.col("j.start")).cast("timestamp_ntz")
    return j.select("candidate_id", start.alias("started"), F.col("j.confidence").alias("confidence"), F.coalesce(F.col("j.confidence").between(0, 1), F.lit(False)).alias("sound"))


@family.query("""WITH t AS (SELECT DISTINCT tenant_id, lower(trim(object_id)) AS k FROM erasure_tombstone WHERE object_type = 'MEMORY_LINEAGE')
SELECT DISTINCT l.memory_id, predicate FROM memory_lineage l JOIN t ON l.tenant_id = t.tenant_id AND lower(trim(l.memory_id)) = k""")
def erased_memories(spark: SparkSession, folder: str) -> DataFrame:
    return E.hidden(table(spark, folder, "memory_lineage"), table(spark, folder, "erasure_tombstone"), "MEMORY_LINEAGE", "memory_id").select("memory_id", "predicate").distinct()


@family.query("""WITH t AS (SELECT DISTINCT tenant_id, lower(trim(object_id)) AS k FROM erasure_tombstone WHERE object_type = 'MEMORY_LINEAGE')
SELECT DISTINCT version_id, memory_id FROM memory_search_projection p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.tenant_id = p.tenant_id AND t.k = lower(trim(p.memory_id)))""")
def projection_after_erasure(spark: SparkSession, folder: str) -> DataFrame:
    return E.remaining(table(spark, folder, "memory_search_projection"), table(spark, folder, "erasure_tombstone"), "MEMORY_LINEAGE", "memory_id").select("version_id", "memory_id").distinct()


@family.query("""WITH t AS (SELECT DISTINCT tenant_id, lower(trim(object_id)) AS k, true AS gone FROM erasure_tombstone WHERE object_type = 'MEMORY_LINEAGE')
SELECT DISTINCT version_id, CASE WHEN gone THEN 'ERASED' ELSE content_state END AS content_state, CASE WHEN gone IS NULL THEN value_json END AS value_json, CASE WHEN gone IS NULL THEN normalized_content END AS normalized_content
FROM memory_version v LEFT JOIN t ON t.tenant_id = v.tenant_id AND t.k = lower(trim(v.memory_id))""")
def redacted_versions(spark: SparkSession, folder: str) -> DataFrame:
    out = E.redacted(table(spark, folder, "memory_version"), table(spark, folder, "erasure_tombstone"), "MEMORY_LINEAGE", "memory_id", ("value_json", "normalized_content"), "content_state")
    return out.select("version_id", "content_state", "value_json", "normalized_content").distinct()


@family.query("""SELECT DISTINCT tenant_id, 'SOURCE_EVENT' AS object_type, source_event_id AS object_id FROM source_event WHERE deletion_state = 'ERASED'
AND NOT EXISTS (SELECT 1 FROM erasure_tombstone t WHERE t.tenant_id = source_event.tenant_id AND t.object_type = 'SOURCE_EVENT' AND t.object_id = source_event_id)""")
def missing_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "source_event").where("deletion_state = 'ERASED'").select("tenant_id", F.lit("SOURCE_EVENT").alias("object_type"), F.col("source_event_id").alias("object_id"))
    return E.new_tombstones(gone, table(spark, folder, "erasure_tombstone"))


@family.query("""WITH p AS (SELECT DISTINCT version_id, s FROM (SELECT version_id, unnest(source_event_ids) AS s FROM memory_search_projection) WHERE s IS NOT NULL AND trim(s) <> '')
SELECT version_id, list(s ORDER BY s) AS sources, count(*)::BIGINT AS n_sources FROM p GROUP BY 1""")
def provenance_sets(spark: SparkSession, folder: str) -> DataFrame:
    """array_agg(DISTINCT … ORDER BY …) over the exploded provenance, distinct before it is collected."""
    p = table(spark, folder, "memory_search_projection").select("version_id", F.explode("source_event_ids").alias("s")).where(F.trim("s") != "").distinct()
    return p.groupBy("version_id").agg(F.array_sort(F.collect_list("s")).alias("sources"), F.count("*").alias("n_sources"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the proposed and the decided outcome."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "tenant_id", "proposed_decision", "memory_type", "sensitivity"), "candidate_id")
    d = one_of_copies(table(spark, folder, "candidate_policy_decision", "decision_id", "candidate_id", "tenant_id", "decision"), "decision_id")
    return c.join(d, ["candidate_id", "tenant_id"])


_JUDGED = """WITH c AS (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL), d AS (SELECT DISTINCT ON (decision_id) * FROM candidate_policy_decision WHERE decision_id IS NOT NULL),
j AS (SELECT c.candidate_id, proposed_decision, decision, memory_type, sensitivity FROM c JOIN d ON c.candidate_id = d.candidate_id AND c.tenant_id = d.tenant_id),
long AS (SELECT memory_type, decision AS label, coalesce(decision = proposed_decision, false) AS same, 1 AS g FROM j UNION ALL SELECT memory_type, proposed_decision, coalesce(decision = proposed_decision, false), 0 FROM j),
"""
_PRF = """tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round_even(tp / nullif(tp + fp, 0), 6) AS precision, round_even(tp / nullif(tp + fn, 0), 6) AS recall, round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
_TALLY = "count(*) FILTER (same AND g = 1) AS tp, count(*) FILTER (NOT same AND g = 0) AS fp, count(*) FILTER (NOT same AND g = 1) AS fn"


@family.query(_JUDGED + f"n AS (SELECT label, {_TALLY} FROM long WHERE label IS NOT NULL GROUP BY 1) SELECT label, {_PRF} FROM n")
def decision_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of proposed decisions against decided ones."""
    return V.prf(V.confusion(_judged(spark, folder), "decision", "proposed_decision"))


@family.query(_JUDGED + f"n AS (SELECT memory_type, label, {_TALLY} FROM long WHERE label IS NOT NULL GROUP BY 1, 2) SELECT memory_type, label, {_PRF} FROM n")
def grouped_prf(spark: SparkSession, folder: str) -> DataFrame:
    return V.prf(V.confusion(_judged(spark, folder), "decision", "proposed_decision", "memory_type"))


@family.query(_JUDGED + f"n AS (SELECT label, {_TALLY} FROM long WHERE label IS NOT NULL GROUP BY 1) SELECT round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 9) AS macro_f1, count(*)::BIGINT AS n_classes FROM n")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    n = V.confusion(_judged(spark, folder), "decision", "proposed_decision")
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return n.agg(F.round(F.avg(F.when(whole != 0, 2 * F.col("tp") / whole)), 9).alias("macro_f1"), F.count("*").alias("n_classes"))


@family.query(_JUDGED + """t AS (SELECT candidate_id, decision, unnest(sensitivity) AS category FROM j)
SELECT category, count(*)::BIGINT AS n, count(*) FILTER (decision = 'REMEMBER')::BIGINT AS n_kept, round_even(count(*) FILTER (decision = 'REMEMBER') / count(*), 6) AS share_kept FROM t GROUP BY 1""")
def coverage_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-label roll-up over an exploded array."""
    t = _judged(spark, folder).select("decision", F.explode("sensitivity").alias("category"))
    kept = F.count_if(F.col("decision") == "REMEMBER")
    return t.groupBy("category").agg(F.count("*").alias("n"), kept.alias("n_kept"), ratio(kept, F.count("*")).alias("share_kept"))


@family.query("SELECT event_type, count(*)::BIGINT AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return V.nearest_rank(table(spark, folder, "events"), "value", "event_type")


_STORED = {"source_event": ("payload", "source_event_id"), "memory_candidate": ("normalized_content", "value_json"), "memory_version": ("normalized_content", "value_json"), "memory_search_projection": ("normalized_content", "version_id"), "documents": ("text", "lang")}


@family.query(" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*)::BIGINT AS n_rows, coalesce(sum({' + '.join(f'coalesce(strlen({c}), 0)' for c in cols)}), 0)::BIGINT AS n_bytes FROM {t}" for t, cols in _STORED.items()))
def storage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A union of one aggregate per relation."""
    return reduce(DataFrame.unionByName, (V.text_bytes(table(spark, folder, t), t, cols) for t, cols in _STORED.items()))


_RELATIONS = ("candidate_policy_decision", "customer", "documents", "embedding_model", "embeddings", "erasure_tombstone", "events", "lineitem", "memory_candidate", "memory_lineage", "memory_search_projection", "memory_version", "nation", "orders", "part", "person_name_token", "predicate_catalog", "region", "source_event", "supplier", "token_budget")


@family.query()
def storage_rollup_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of whole rows as JSON over every relation, and their mean; engines differ in how they write JSON."""
    every = reduce(DataFrame.unionByName, (V.payload_bytes(table(spark, folder, t), t) for t in _RELATIONS))
    return every.withColumn("mean_bytes", F.round(F.try_divide("n_bytes", "n_rows"), 3))


@family.query("""WITH k AS (SELECT DISTINCT tenant_id FROM memory_lineage), b AS (SELECT unnest(['full-history', 'summary', 'vector', 'versioned']) AS baseline)
SELECT tenant_id, baseline, unnest(range(1, 4))::INTEGER AS repetition FROM k, b""")
def expected_rows(spark: SparkSession, folder: str) -> DataFrame:
    b = spark.createDataFrame([(x,) for x in ("full-history", "summary", "vector", "versioned")], "baseline string")
    return V.expansion(table(spark, folder, "memory_lineage", "tenant_id").distinct(), b, 3)


@family.query("""WITH a AS (SELECT DISTINCT version_id FROM memory_version WHERE content_state = 'AVAILABLE'), b AS (SELECT DISTINCT version_id FROM memory_search_projection)
SELECT version_id, 'missing' AS problem FROM (FROM a EXCEPT FROM b) UNION ALL SELECT version_id, 'unexpected' FROM (FROM b EXCEPT FROM a)""")
def projection_key_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Set difference both ways: versions that lack a projection, projections without an available version."""
    a = table(spark, folder, "memory_version").where("content_state = 'AVAILABLE'").select("version_id").distinct()
    return V.key_differences(a, table(spark, folder, "memory_search_projection", "version_id").distinct())


@family.query("""SELECT run_id, count(DISTINCT candidate_id)::BIGINT AS n_candidates, count(DISTINCT candidate_id) FILTER (content_state = 'ERASED')::BIGINT AS n_erased, max(ordinal) + 1 AS next_ordinal, bool_and(content_state = 'AVAILABLE') AS complete,
min(created_at) AS first_created, max(created_at) AS last_created FROM memory_candidate GROUP BY 1""")
def run_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per extraction run: filtered distinct counts, next ordinal, and-ed flags and time bounds in one aggregation."""
    c = table(spark, folder, "memory_candidate")
    return c.groupBy("run_id").agg(
        F.countDistinct("candidate_id").alias("n_candidates"), F.countDistinct(F.when(F.col("content_state") == "ERASED", F.col("candidate_id"))).alias("n_erased"), (F.max("ordinal") + 1).alias("next_ordinal"),
        F.bool_and(F.col("content_state") == "AVAILABLE").alias("complete"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"),
    )


@family.query("""SELECT tenant_id, memory_id, version_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY version_number DESC, version_id) AS r FROM
(SELECT DISTINCT ON (version_id) * FROM memory_version)) WHERE r <= 2""")
def last_two_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The last n rows of each key."""
    from mnemoframe.operators.relational import top_per_key

    v = one_of_copies(table(spark, folder, "memory_version", "tenant_id", "memory_id", "version_id", "version_number"), "version_id")
    return top_per_key(v, ["memory_id"], 2, F.desc("version_number"), F.asc("version_id")).drop("rank")


@family.query("""WITH o AS (SELECT memory_id, 0::BIGINT AS seq, 'lineage' AS origin FROM (SELECT DISTINCT memory_id FROM memory_lineage)), n AS (SELECT memory_id, max(version_number) AS seq, 'version' AS origin FROM memory_version GROUP BY 1)
SELECT memory_id, seq, origin FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC, origin DESC) AS r FROM (FROM o UNION ALL FROM n)) WHERE r = 1""")
def upsert_by_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Monotonic upsert: a row gives way only to a later sequence."""
    old = table(spark, folder, "memory_lineage", "memory_id").distinct().select("memory_id", F.lit(0).cast("bigint").alias("seq"), F.lit("lineage").alias("origin"))
    new = table(spark, folder, "memory_version").groupBy("memory_id").agg(F.max("version_number").alias("seq")).withColumn("origin", F.lit("version"))
    return upsert_latest(old, new, ["memory_id"], "seq")


@family.query("SELECT source_event_id, count(DISTINCT payload)::BIGINT AS n_payloads FROM source_event GROUP BY 1 HAVING count(DISTINCT payload) > 1")
def immutability_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only guard: no id with two payloads."""
    return table(spark, folder, "source_event").groupBy("source_event_id").agg(F.countDistinct("payload").alias("n_payloads")).where("n_payloads > 1")


@family.query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS began, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("began"), "n", "total")


@family.query("""WITH s AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS began, count(*)::BIGINT AS n FROM g GROUP BY user_id, g""")
def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@family.query()
def folded_text(spark: SparkSession, folder: str) -> DataFrame:
    """NFKC and case folding, which SQL lacks."""
    return table(spark, folder, "documents").select("doc_id", udfs.folded("text").alias("folded"))


@family.query()
def canonical_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads as canonical JSON; null where they are not JSON."""
    return table(spark, folder, "source_event").select("source_event_id", udfs.canonical_json("payload").alias("canonical"))


@family.query()
def strict_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded strict decoding of payloads, with the kind and place of the error."""
    return table(spark, folder, "source_event").select("source_event_id", udfs.strict_check("payload").alias("c")).select("source_event_id", "c.*")


@family.query()
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The deterministic hashing embedder over the distinct catalog and name words and lineage labels."""
    parts = (("predicate_catalog", "predicate"), ("person_name_token", "name_token"), ("memory_lineage", "subject_label"))
    labels = reduce(DataFrame.unionByName, (table(spark, folder, t).select(F.col(c).alias("label")) for t, c in parts)).distinct()
    return labels.select("label", udfs.hash_embedding("label").alias("embedding"))


# the values here are scalars or objects of one level, so keys need no recursion
@family.query("""WITH w AS (SELECT version_id, value_json AS b, lag(value_json) OVER (PARTITION BY memory_id ORDER BY version_number, version_id) AS a FROM (SELECT DISTINCT ON (version_id) * FROM memory_version WHERE version_id IS NOT NULL)),
p AS (SELECT *, json_valid(a) AND json_valid(b) AS sound FROM w WHERE a <> b), t AS (SELECT *, sound AND json_type(CASE WHEN sound THEN a ELSE 'null' END) = 'OBJECT' AND json_type(CASE WHEN sound THEN b ELSE 'null' END) = 'OBJECT' AS nested FROM p),
k AS (SELECT version_id, a, b, unnest(list_distinct(json_keys(a) || json_keys(b))) AS k FROM t WHERE nested)
SELECT version_id, '$.' || k AS path FROM k WHERE json_extract(a, k) IS DISTINCT FROM json_extract(b, k)
UNION ALL SELECT version_id, '$' FROM t WHERE NOT nested AND NOT coalesce(sound AND json(CASE WHEN sound THEN a END) = json(CASE WHEN sound THEN b END), false)""")
def json_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Paths at which the values of consecutive versions differ."""
    from pyspark.sql import Window

    w = Window.partitionBy("memory_id").orderBy("version_number", "version_id")
    v = one_of_copies(table(spark, folder, "memory_version", "memory_id", "version_id", "version_number", "value_json"), "version_id").withColumn("old", F.lag("value_json").over(w)).where("old IS NOT NULL AND value_json IS NOT NULL")
    return v.where("old <> value_json").select("version_id", F.explode(udfs.json_differences("old", "value_json")).alias("path"))


@family.query("""SELECT * FROM (
SELECT 'memory_version' AS relation, 'interval_in_order' AS rule, count(*) FILTER (valid_time_start >= valid_time_end)::BIGINT AS n FROM memory_version
UNION ALL SELECT 'memory_version', 'number_positive', count(*) FILTER (version_number < 1)::BIGINT FROM memory_version
UNION ALL SELECT 'memory_candidate', 'confidence_in_unit', count(*) FILTER (confidence NOT BETWEEN 0 AND 1)::BIGINT FROM memory_candidate
UNION ALL SELECT 'memory_candidate', 'erased_is_empty', count(*) FILTER (content_state = 'ERASED' AND normalized_content IS NOT NULL)::BIGINT FROM memory_candidate
UNION ALL SELECT 'memory_search_projection', 'length_as_stated', count(*) FILTER (len(embedding) <> embedding_dimensions)::BIGINT FROM memory_search_projection
UNION ALL SELECT 'memory_search_projection', 'has_sources', count(*) FILTER (source_event_ids IS NULL OR len(source_event_ids) = 0)::BIGINT FROM memory_search_projection
UNION ALL SELECT 'source_event', 'arrives_after', count(*) FILTER (received_at < occurred_at)::BIGINT FROM source_event
UNION ALL SELECT 'documents', 'n_chars_fits', count(*) FILTER (n_chars <> length(text))::BIGINT FROM documents) WHERE n > 0""")
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    from mnemoframe.operators.constraints import many

    c = F.col
    return many({
        "memory_version": (table(spark, folder, "memory_version"), {"interval_in_order": c("valid_time_start") < c("valid_time_end"), "number_positive": c("version_number") >= 1}),
        "memory_candidate": (table(spark, folder, "memory_candidate"), {"confidence_in_unit": c("confidence").between(0, 1), "erased_is_empty": ~((c("content_state") == "ERASED") & c("normalized_content").isNotNull())}),
        "memory_search_projection": (table(spark, folder, "memory_search_projection"), {"length_as_stated": F.size("embedding") == c("embedding_dimensions"), "has_sources": c("source_event_ids").isNotNull() & (F.size("source_event_ids") > 0)}),
        "source_event": (table(spark, folder, "source_event"), {"arrives_after": c("received_at") >= c("occurred_at")}),
        "documents": (table(spark, folder, "documents"), {"n_chars_fits": c("n_chars") == F.length("text")}),
    })


@family.query("""WITH d AS (SELECT session_id, list({'used': coalesce(length(text), 0)::BIGINT, 'ids': [doc_id], 'totals': [0::BIGINT]} ORDER BY created_at DESC NULLS LAST, doc_id) AS items
  FROM documents WHERE session_id IS NOT NULL GROUP BY 1),
f AS (SELECT session_id, list_reduce(items, lambda acc, x: CASE WHEN acc.used + x.used <= 4000 THEN {'used': acc.used + x.used, 'ids': acc.ids || x.ids, 'totals': acc.totals || [acc.used + x.used]} ELSE acc END,
  {'used': 0::BIGINT, 'ids': []::BIGINT[], 'totals': []::BIGINT[]}) AS r FROM d),
u AS (SELECT session_id, unnest(r.ids) AS doc_id, unnest(r.totals) AS used FROM f)
SELECT u.session_id, u.doc_id, coalesce(length(text), 0)::BIGINT AS size, used FROM u JOIN documents USING (doc_id)""")
def recent_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's newest documents within 4,000 characters; an ordered fold, checked on small cases."""
    from mnemoframe.operators.budget import choose

    d = table(spark, folder, "documents", "session_id", "doc_id", "text", "created_at").where("session_id IS NOT NULL")
    return choose(d, "session_id", "doc_id", F.length("text"), 4000, F.col("created_at"))


@family.query("""WITH n AS (SELECT scale, baseline, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS n FROM (
SELECT 'answer' AS scale, source AS baseline, length(text) AS tokens FROM documents UNION ALL SELECT 'retrieval', predicate, length(normalized_content) FROM memory_version JOIN
(SELECT DISTINCT memory_id, predicate FROM memory_lineage) USING (memory_id)) GROUP BY 1, 2) SELECT * FROM n""")
def cost_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Token sums over a union of different row kinds."""
    a = table(spark, folder, "documents").select(F.lit("answer").alias("scale"), F.col("source").alias("baseline"), F.length("text").alias("tokens"))
    p = table(spark, folder, "memory_lineage", "memory_id", "predicate").distinct()
    b = table(spark, folder, "memory_version", "memory_id", "normalized_content").join(p, "memory_id").select(F.lit("retrieval").alias("scale"), F.col("predicate").alias("baseline"), F.length("normalized_content").alias("tokens"))
    return a.unionByName(b).groupBy("scale", "baseline").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


@family.query("""WITH v AS (SELECT DISTINCT ON (version_id) * FROM memory_version WHERE content_state = 'AVAILABLE'), l AS (SELECT DISTINCT memory_id, tenant_id, predicate FROM memory_lineage WHERE lifecycle_state = 'ACTIVE'),
c AS (SELECT DISTINCT candidate_id, source_event_id FROM memory_candidate WHERE candidate_id IS NOT NULL)
SELECT v.version_id, v.memory_id, predicate, normalized_content, list(DISTINCT c.source_event_id ORDER BY c.source_event_id) FILTER (c.source_event_id IS NOT NULL) AS source_event_ids
FROM v JOIN l ON v.memory_id = l.memory_id AND v.tenant_id = l.tenant_id LEFT JOIN c ON v.candidate_id = c.candidate_id GROUP BY ALL""")
def projection_build(spark: SparkSession, folder: str) -> DataFrame:
    """The search projection from its sources: active lineages, available versions, sorted provenance."""
    v = one_of_copies(table(spark, folder, "memory_version").where("content_state = 'AVAILABLE'"), "version_id").select("version_id", "memory_id", "tenant_id", "candidate_id", "normalized_content")
    lineages = table(spark, folder, "memory_lineage").where("lifecycle_state = 'ACTIVE'").select("memory_id", "tenant_id", "predicate").distinct()
    c = table(spark, folder, "memory_candidate", "candidate_id", "source_event_id").where("candidate_id IS NOT NULL").distinct()
    sources = v.select("version_id", "candidate_id").join(c, "candidate_id").groupBy("version_id").agg(F.array_sort(F.collect_set("source_event_id")).alias("source_event_ids"))
    return v.join(lineages, ["memory_id", "tenant_id"]).join(sources, "version_id", "left").select("version_id", "memory_id", "predicate", "normalized_content", "source_event_ids")


@family.query("SELECT DISTINCT source_event_id FROM source_event WHERE source_event_id IS NOT NULL")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that a deduplicating stream lets through: state covers 30 days of arrivals, what comes again later falls to the batch that reads the output."""
    from mnemoframe.streaming import pipelines as P

    e = P.source(spark, folder, "source_event").where("source_event_id IS NOT NULL").select("source_event_id", "received_at")
    return P.drain(P.deduplicated(e, "30 days")).select("source_event_id").distinct()


@family.query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS began, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Window counts of the event stream in complete mode."""
    from mnemoframe.streaming import pipelines as P

    out = P.drain(P.windowed(P.source(spark, folder, "events")), "complete")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@family.query("""WITH d AS (SELECT session_id, doc_id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at, doc_id) - 1 AS position FROM documents WHERE session_id IS NOT NULL AND created_at IS NOT NULL)
SELECT session_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS r FROM d WHERE created_at <= TIMESTAMP '2025-06-01') WHERE r <= 2""")
def recent_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Positions within each session, and the last two up to a cut-off.

    The last two are a partial top-k and a position is a count before the cut-off, so no session is sorted as a whole.
    """
    from mnemoframe.operators.relational import top_per_key

    d = table(spark, folder, "documents", "session_id", "doc_id", "created_at").where("session_id IS NOT NULL AND created_at IS NOT NULL")
    d = d.where(F.col("created_at") <= F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")))
    last = top_per_key(d, ["session_id"], 2, F.desc("created_at"), F.desc("doc_id"))
    sizes = d.groupBy("session_id").agg(F.count("*").alias("n"))
    return last.join(sizes, "session_id").select("session_id", "doc_id", (F.col("n") - F.col("rank")).alias("position"))


@family.query("""WITH p AS (SELECT DISTINCT ON (version_id) version_id, memory_id, list_filter(source_event_ids, lambda s: s IS NOT NULL AND trim(s) <> '') AS cited FROM memory_search_projection WHERE version_id IS NOT NULL AND source_event_ids IS NOT NULL),
c AS (SELECT v.version_id, list(DISTINCT source_event_id ORDER BY source_event_id) AS gold FROM (SELECT DISTINCT version_id, candidate_id FROM memory_version) v JOIN (SELECT DISTINCT candidate_id, source_event_id FROM memory_candidate) USING (candidate_id) GROUP BY 1)
SELECT version_id, len(list_intersect(list_distinct(cited), gold))::INTEGER AS n_shared, list_has_all(cited, gold) AS complete, list_has_all(gold, cited) AS only_gold,
round_even(len(list_intersect(list_distinct(cited), gold)) / nullif(len(list_distinct(cited)), 0), 6) AS precision, round_even(len(list_intersect(list_distinct(cited), gold)) / len(gold), 6) AS recall
FROM p JOIN c USING (version_id)""")
def citation_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cited sources against those of the version's candidate: complete, valid, precision and fractional recall."""
    p = one_of_copies(table(spark, folder, "memory_search_projection", "version_id", "source_event_ids"), "version_id").where("source_event_ids IS NOT NULL")
    p = p.select("version_id", F.array_distinct(F.filter("source_event_ids", lambda s: s.isNotNull() & (F.trim(s) != ""))).alias("cited"))
    v = table(spark, folder, "memory_version", "version_id", "candidate_id").distinct()
    c = table(spark, folder, "memory_candidate", "candidate_id", "source_event_id").distinct()
    gold = v.join(c, "candidate_id").groupBy("version_id").agg(F.array_sort(F.collect_set("source_event_id")).alias("gold"))
    shared = F.size(F.array_intersect("cited", "gold"))
    return p.join(gold, "version_id").select(
        "version_id", shared.alias("n_shared"), (F.size(F.array_except("gold", "cited")) == 0).alias("complete"), (F.size(F.array_except("cited", "gold")) == 0).alias("only_gold"),
        ratio(shared, F.size("cited")).alias("precision"), ratio(shared, F.size("gold")).alias("recall"),
    )


@family.query("""WITH e AS (SELECT user_id, ts, value, coalesce(min(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS before FROM events)
SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (before = 1)::BIGINT AS n_repeat, round(sum(value), 6) AS total FROM e GROUP BY 1""")
def hourly_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Events that follow another of the same user within the hour: a range frame, not a join."""
    from pyspark.sql import Window

    times = table(spark, folder, "events").select("user_id", "ts", "value").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    back = F.max("us").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, -1))
    return times.withColumn("back", back).groupBy("user_id").agg(F.count("*").alias("n"), F.count("back").alias("n_repeat"), F.round(F.sum("value"), 6).alias("total"))


@family.query("""WITH j AS (SELECT memory_type, subject_kind, content_state FROM (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL))
SELECT memory_type, subject_kind, count(*)::BIGINT AS n, count(*) FILTER (content_state = 'ERASED')::BIGINT AS n_erased, grouping(memory_type)::INTEGER AS all_types, grouping(subject_kind)::INTEGER AS all_kinds
FROM j GROUP BY GROUPING SETS ((memory_type, subject_kind), (memory_type), (subject_kind), ())""")
def grouped_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Roll-ups by several labels at once."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "memory_type", "subject_kind", "content_state"), "candidate_id")
    return c.cube("memory_type", "subject_kind").agg(F.count("*").alias("n"), F.count_if(F.col("content_state") == "ERASED").alias("n_erased"), F.grouping("memory_type").cast("int").alias("all_types"), F.grouping("subject_kind").cast("int").alias("all_kinds"))
