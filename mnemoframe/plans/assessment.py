"""Corrections, receipts, evaluation and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.functions.text import trimmed_key
from mnemoframe.operators import corrections as C, evaluation as V, history as H, retrieve as R
from mnemoframe.operators.relational import one_of_copies, ratio
from mnemoframe.plans import memories as M
from mnemoframe.plans.family import Family
from mnemoframe.plans.history import AT, LOG, log, ntz
from mnemoframe.plans.records import _BYTES, _JUDGED, _judged
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL
_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"
_UUID = "h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32]"


@family.query(LOG + f""", d AS (SELECT DISTINCT ON (decision_id) decision_id AS command_id, lower(trim(candidate_id, {_SPACE})) AS k, decided_at AS done_at, CASE decision WHEN 'IGNORE' THEN 'INVALIDATE' ELSE 'CORRECT' END AS kind
  FROM candidate_policy_decision WHERE decision_id IS NOT NULL AND decision <> 'REMEMBER' AND trim(candidate_id, {_SPACE}) <> ''),
t AS (SELECT version_id, lower(trim(candidate_id, {_SPACE})) AS k FROM v WHERE trim(candidate_id, {_SPACE}) <> ''),
c AS (SELECT command_id, version_id, kind, row_number() OVER (PARTITION BY version_id ORDER BY done_at NULLS LAST, command_id) AS r, md5(command_id) AS h FROM d LEFT JOIN t USING (k))
SELECT command_id, c.version_id, kind, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN r = 1 THEN 'APPLIED' ELSE 'ALREADY_INVALIDATED' END AS outcome, CASE WHEN r = 1 THEN status END AS from_status,
  CASE WHEN status IS NOT NULL AND r = 1 AND kind = 'CORRECT' THEN {_UUID} END AS replacement_id FROM c LEFT JOIN state USING (version_id)""")
def correction_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions that come after the fact as commands: IGNORE invalidates the candidate's version, any other but REMEMBER corrects it."""
    d = one_of_copies(table(spark, folder, "candidate_policy_decision", "decision_id", "candidate_id", "decision", "decided_at"), "decision_id").where("decision <> 'REMEMBER'")
    d = d.select(F.col("decision_id").alias("command_id"), trimmed_key(F.col("candidate_id")).alias("k"), F.col("decided_at").alias("at"), F.when(F.col("decision") == "IGNORE", "INVALIDATE").otherwise("CORRECT").alias("kind")).where("k IS NOT NULL")
    v = one_of_copies(table(spark, folder, "memory_version", "version_id", "candidate_id"), "version_id").select("version_id", trimmed_key(F.col("candidate_id")).alias("k")).where("k IS NOT NULL")
    return C.apply_commands(d.join(v, "k", "left").drop("k"), H.current_state(log(spark, folder)))


_MUTATION = "sha256(" + " || ".join(_BYTES.format(c) for c in ("source_id", "payload")) + ")"


@family.query(f"""WITH m AS (SELECT tenant_id, user_id, agent_id, idempotency_key, source_event_id, received_at AS done_at, {_MUTATION} AS p FROM source_event),
f AS (SELECT DISTINCT ON (tenant_id, user_id, agent_id, idempotency_key) tenant_id, user_id, agent_id, idempotency_key, source_event_id AS fi, done_at AS fa, p AS fp FROM m ORDER BY tenant_id, user_id, agent_id, idempotency_key, done_at NULLS LAST, source_event_id, p)
SELECT tenant_id, user_id, agent_id, idempotency_key, source_event_id, CASE WHEN done_at IS NOT DISTINCT FROM fa AND source_event_id = fi AND p = fp THEN 'APPLIED' WHEN p = fp THEN 'IDEMPOTENT_REPLAY' ELSE 'CONFLICT' END AS disposition,
  CASE WHEN p = fp THEN fi END AS first_receipt FROM m JOIN f USING (tenant_id, user_id, agent_id, idempotency_key)""")
def mutation_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Keys scoped to tenant, user and agent; same key and content gives the first receipt again."""
    return C.receipts(table(spark, folder, "source_event"), ("tenant_id", "user_id", "agent_id", "idempotency_key"), ("source_id", "payload"), "source_event_id", "received_at")


@family.query(LOG + "SELECT tenant_id, memory_id, version_id, status, since FROM state")
def current_state_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A state stored at a time with the changes after it merged in: what rebuilding from the whole log gives."""
    changes, at = log(spark, folder), ntz(AT)
    stored = C.merged_state(changes.limit(0).select("tenant_id", "memory_id", "version_id", "sequence", "ordinal", F.col("to_status").alias("status"), F.col("occurred_at").alias("since")), changes.where(F.col("occurred_at") <= at))
    return C.merged_state(stored, changes.where(F.col("occurred_at") > at)).select("tenant_id", "memory_id", "version_id", "status", "since")


_CLEAN = "list_filter(coalesce({0}, []), lambda s: s IS NOT NULL AND trim(s) <> '')"
_EVIDENCE = M.SQL["evidence_context"].rpartition("SELECT query_id, n_ranked")[0] + f""", gold AS (SELECT version_id AS query_id, memory_id, list_distinct({_CLEAN.format('sources')}) AS gold FROM m WHERE version_id IN (SELECT query_id FROM q)),
old AS (SELECT memory_id, list_distinct(flatten(list({_CLEAN.format('sources')}))) AS past FROM m WHERE status IN ('HISTORICAL', 'INVALIDATED') GROUP BY 1),
placed AS (SELECT query_id, s, min(rank * 1000000 + i) AS place FROM (SELECT query_id, rank, unnest({_CLEAN.format('sources')}) AS s, generate_subscripts({_CLEAN.format('sources')}, 1) AS i FROM r JOIN m USING (version_id)) GROUP BY 1, 2),
ids AS (SELECT query_id, list(s ORDER BY place) AS ranked FROM placed GROUP BY 1),
sel AS (SELECT query_id, list_distinct(flatten(list({_CLEAN.format('sources')}))) AS selected FROM (SELECT query_id, unnest(a.chosen) AS version_id FROM z) JOIN m USING (version_id) GROUP BY 1),
x AS (SELECT query_id, gold, coalesce(ranked, []) AS ranked, coalesce(selected, []) AS selected, list_filter(coalesce(past, []), lambda s: NOT list_contains(gold, s)) AS forbidden
  FROM z JOIN gold USING (query_id) LEFT JOIN ids USING (query_id) LEFT JOIN sel USING (query_id) LEFT JOIN old USING (memory_id) WHERE len(gold) > 0),
e AS (SELECT query_id, len(list_intersect(gold, ranked)) > 0 AS hit, list_has_all(ranked, gold) AS complete, coalesce(1 / list_min(list_filter(list_transform(gold, lambda g: list_position(ranked, g)), lambda p: p > 0)), 0)::DOUBLE AS reciprocal_rank,
  round_even(len(list_intersect(gold, ranked)) / len(gold), 6) AS recall, coalesce(round_even(len(list_intersect(gold, ranked)) / nullif(len(ranked), 0), 6), 0) AS precision, list_has_all(selected, gold) AS selected_complete,
  len(list_intersect(gold, selected))::INTEGER AS selected_relevant, len(selected)::INTEGER AS selected_total, len(forbidden) > 0 AS forbidden_labeled, len(list_intersect(forbidden, selected)) > 0 AS forbidden_exposure,
  CASE WHEN NOT list_has_all(ranked, gold) THEN 'retrieval' WHEN NOT list_has_all(selected, gold) THEN 'context' ELSE 'none' END AS failure_stage FROM x)
"""


@family.query(_EVIDENCE + "SELECT * FROM e")
def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per query, its own sources as gold against ranked and selected ones: hit, complete, reciprocal rank, fractional recall, precision, exposure of what is past, and where it failed."""
    m = M.memories(spark, folder)
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != ""))
    none = F.array().cast("array<string>")
    best = R.fused(R.candidates(M.asking(m), m, M.COMPONENT), m, M.LIMIT)
    in_order = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", clean(F.col("sources")).alias("s")))).alias("l"))
    ranked = in_order.select("query_id", F.array_distinct(F.flatten(F.col("l").getField("s"))).alias("ranked"))
    chosen = R.contexts(best, M.BUDGET).select("query_id", F.explode_outer("chosen").alias("version_id"))
    picked = chosen.join(best.select("query_id", "version_id", clean(F.col("sources")).alias("s")), ["query_id", "version_id"], "left").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("selected"))
    gold = M.asking(m).select("query_id", "memory_id", F.array_distinct(clean(F.col("sources"))).alias("gold")).where(F.size("gold") > 0)
    past = m.where(F.col("status").isin("HISTORICAL", "INVALIDATED")).select("memory_id", F.explode(clean(F.col("sources"))).alias("s")).distinct().groupBy("memory_id").agg(F.collect_list("s").alias("past"))
    x = ranked.join(gold, "query_id").join(picked, "query_id", "left").join(past, "memory_id", "left").select(
        "query_id", "gold", "ranked", F.coalesce("selected", none).alias("selected"), F.array_except(F.coalesce("past", none), "gold").alias("forbidden")
    )
    return x.select("query_id", *V.evidence_scores(*(F.col(c) for c in ("gold", "ranked", "selected", "forbidden"))))


@family.query(_EVIDENCE + """SELECT count(*)::BIGINT AS eligible, round_even(count(*) FILTER (hit) / count(*), 6) AS recall_at_k, round_even(count(*) FILTER (complete) / count(*), 6) AS complete_recall_at_k, round_even(count(*) FILTER (selected_complete) / count(*), 6) AS selected_complete_rate,
round(sum(reciprocal_rank) / count(*), 6) AS mrr, round_even(sum(selected_relevant) / nullif(sum(selected_total), 0), 6) AS context_precision, count(*) FILTER (forbidden_labeled)::BIGINT AS forbidden_context_labeled,
round_even(count(*) FILTER (forbidden_exposure) / nullif(count(*) FILTER (forbidden_labeled), 0), 6) AS forbidden_context_exposure_rate FROM e""")
def evidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    e, n = evidence_scores(spark, folder), F.count("*")
    return e.agg(
        n.alias("eligible"), ratio(F.count_if("hit"), n).alias("recall_at_k"), ratio(F.count_if("complete"), n).alias("complete_recall_at_k"), ratio(F.count_if("selected_complete"), n).alias("selected_complete_rate"),
        F.round(F.sum("reciprocal_rank") / n, 6).alias("mrr"), ratio(F.sum("selected_relevant"), F.sum("selected_total")).alias("context_precision"), F.count_if("forbidden_labeled").alias("forbidden_context_labeled"),
        ratio(F.count_if("forbidden_exposure"), F.count_if("forbidden_labeled")).alias("forbidden_context_exposure_rate"),
    )


@family.query("""WITH e AS (SELECT memory_id, list_sort(list(DISTINCT normalized_content)) AS acceptable FROM memory_version WHERE content_state = 'AVAILABLE' AND normalized_content IS NOT NULL GROUP BY 1),
p AS (SELECT memory_id, coalesce(list_sort(list(DISTINCT normalized_content) FILTER (truth_status = 'CURRENT')), []) AS items, coalesce(list(DISTINCT normalized_content) FILTER (truth_status = 'HISTORICAL'), []) AS past FROM memory_search_projection WHERE normalized_content IS NOT NULL GROUP BY 1),
l AS (SELECT memory_id, min(predicate_cardinality) AS c FROM memory_lineage WHERE memory_id IS NOT NULL GROUP BY 1),
j AS (SELECT memory_id, CASE WHEN acceptable IS NULL THEN 'ABSTAIN' WHEN c = 'SET' THEN 'SET' ELSE 'TEXT' END AS kind, coalesce(acceptable, []) AS acceptable, coalesce(items, []) AS items, coalesce(past, []) AS past FROM l LEFT JOIN e USING (memory_id) LEFT JOIN p USING (memory_id)),
s AS (SELECT memory_id, kind, CASE kind WHEN 'ABSTAIN' THEN len(items) = 0 WHEN 'SET' THEN items = acceptable ELSE len(items) = 1 AND list_has_all(acceptable, items) END AS fits, len(list_filter(past, lambda b: len(list_filter(items, lambda i: contains(lower(i), lower(b)))) > 0)) > 0 AS leaks FROM j)
SELECT memory_id, kind, fits AND NOT leaks AS correct, leaks AS forbidden_leakage FROM s""")
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers read from the projection scored against the versions: one text, a set or abstention; a past text within an answer is a leak."""
    v = table(spark, folder, "memory_version", "memory_id", "content_state", "normalized_content").where("content_state = 'AVAILABLE' AND normalized_content IS NOT NULL")
    accept = v.select("memory_id", "normalized_content").distinct().groupBy("memory_id").agg(F.array_sort(F.collect_list("normalized_content")).alias("acceptable"))
    p = table(spark, folder, "memory_search_projection", "memory_id", "truth_status", "normalized_content").where("normalized_content IS NOT NULL").distinct()
    said = p.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.when(F.col("truth_status") == "CURRENT", F.col("normalized_content")))).alias("items"), F.collect_list(F.when(F.col("truth_status") == "HISTORICAL", F.col("normalized_content"))).alias("past"))
    kinds = table(spark, folder, "memory_lineage").where("memory_id IS NOT NULL").groupBy("memory_id").agg(F.min("predicate_cardinality").alias("c"))
    none = F.array().cast("array<string>")
    j = kinds.join(accept, "memory_id", "left").join(said, "memory_id", "left").select(
        "memory_id", F.when(F.col("acceptable").isNull(), "ABSTAIN").when(F.col("c") == "SET", "SET").otherwise("TEXT").alias("kind"), *(F.coalesce(c, none).alias(c) for c in ("acceptable", "items", "past"))
    )
    fits, leaks = V.answer_fits(F.col("kind"), F.col("acceptable"), F.col("items")), V.leaks(F.col("past"), F.col("items"))
    return j.select("memory_id", "kind", (fits & ~leaks).alias("correct"), leaks.alias("forbidden_leakage"))


@family.query("""WITH o AS (SELECT tenant_id, run_id, bool_and(content_state = 'AVAILABLE') AS complete, sum(coalesce(strlen(normalized_content), 0)) AS content, sum(coalesce(strlen(value_json), 0)) AS val FROM (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL) GROUP BY 1, 2)
SELECT tenant_id, count(*)::BIGINT AS observations, bool_and(complete) AS complete, CASE WHEN bool_and(complete) THEN sum(content + val) END::BIGINT AS total_bytes, CASE WHEN bool_and(complete) THEN round_even(sum(content + val) / count(*), 3) END AS mean_bytes,
CASE WHEN bool_and(complete) THEN sum(content) END::BIGINT AS content_bytes, CASE WHEN bool_and(complete) THEN sum(val) END::BIGINT AS value_bytes FROM o GROUP BY 1""")
def retained_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as observations: totals, means and components of a tenant count only if all of its runs are complete."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "tenant_id", "run_id", "content_state", "normalized_content", "value_json"), "candidate_id")
    size = lambda x: F.sum(F.coalesce(F.octet_length(x), F.lit(0)))
    o = c.groupBy("tenant_id", "run_id").agg(F.bool_and(F.col("content_state") == "AVAILABLE").alias("complete"), size("normalized_content").alias("content"), size("value_json").alias("val"))
    return V.storage(o, "tenant_id", {"content_bytes": "content", "value_bytes": "val"})


@family.query("""WITH u AS (SELECT tenant_id, 'writes' AS k, coalesce(length(normalized_content), 0) AS i, coalesce(length(value_json), 0) AS o, 0 AS e, 1 AS c, normalized_content IS NOT NULL AS done FROM memory_candidate
UNION ALL SELECT tenant_id, 'retrieval', coalesce(length(normalized_content), 0), 0, coalesce(embedding_dimensions, 0), 1, embedding IS NOT NULL FROM memory_search_projection
UNION ALL SELECT tenant_id, 'answers', 0, coalesce(len(reason_codes), 0), 0, 1, candidate_id IS NOT NULL FROM candidate_policy_decision)
SELECT tenant_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(e)::BIGINT AS embedding_tokens, sum(c)::BIGINT AS model_calls, bool_and(done) AS complete FROM u GROUP BY 1""")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Four sums over three kinds of rows, each kind summed before the union; complete only if every row is."""
    zero, n = F.lit(0), lambda c: F.coalesce(F.length(c), F.lit(0))
    c = table(spark, folder, "memory_candidate").select("tenant_id", n("normalized_content").alias("i"), n("value_json").alias("o"), zero.alias("e"), F.col("normalized_content").isNotNull().alias("done"))
    p = table(spark, folder, "memory_search_projection").select("tenant_id", n("normalized_content").alias("i"), zero.alias("o"), F.coalesce("embedding_dimensions", zero).alias("e"), F.col("embedding").isNotNull().alias("done"))
    d = table(spark, folder, "candidate_policy_decision").select("tenant_id", zero.alias("i"), F.greatest(F.coalesce(F.size("reason_codes"), zero), zero).alias("o"), zero.alias("e"), F.col("candidate_id").isNotNull().alias("done"))
    return V.usage([c, p, d], "tenant_id")


@family.query(_JUDGED + """n AS (SELECT label, count(*) FILTER (same AND g = 1) AS tp, count(*) FILTER (NOT same AND g = 0) AS fp, count(*) FILTER (NOT same AND g = 1) AS fn FROM long WHERE label IS NOT NULL GROUP BY 1),
r AS (SELECT label, round_even(tp / nullif(tp + fp, 0), 6) AS precision, round_even(tp / nullif(tp + fn, 0), 6) AS recall FROM n) SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN round_even(2 * precision * recall / (precision + recall), 6) END AS f1 FROM r""")
def strict_prf(spark: SparkSession, folder: str) -> DataFrame:
    """F1 from the rounded precision and recall, null where both are zero."""
    p = V.prf(V.confusion(_judged(spark, folder), "decision", "proposed_decision"))
    return p.select("label", "precision", "recall", V.strict_f1(F.col("precision"), F.col("recall")).alias("f1"))


@family.query("""WITH c AS (SELECT DISTINCT ON (candidate_id) * FROM memory_candidate WHERE candidate_id IS NOT NULL), d AS (SELECT tenant_id, candidate_id, max(CASE WHEN decision = 'REMEMBER' THEN 1 ELSE 0 END) AS kept FROM candidate_policy_decision WHERE candidate_id IS NOT NULL GROUP BY 1, 2),
j AS (SELECT memory_type, kept, len(list_filter(coalesce(sensitivity, []), lambda s: s <> 'NONE')) > 0 AS sensitive FROM c LEFT JOIN d ON c.candidate_id = d.candidate_id AND c.tenant_id = d.tenant_id)
SELECT memory_type, count(*)::BIGINT AS n, count(*) FILTER (kept IS NULL)::BIGINT AS n_missing, round_even(count(*) FILTER (kept IS NULL) / count(*), 6) AS missing_rate, count(*) FILTER (kept = 1 AND sensitive)::BIGINT AS n_harmful,
round_even(count(*) FILTER (kept = 1 AND sensitive) / nullif(count(*) FILTER (kept = 1), 0), 6) AS harmful_write_rate FROM j GROUP BY 1""")
def decision_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions that are missing, and sensitive candidates that were kept."""
    c = one_of_copies(table(spark, folder, "memory_candidate", "candidate_id", "tenant_id", "memory_type", "sensitivity"), "candidate_id")
    d = table(spark, folder, "candidate_policy_decision").where("candidate_id IS NOT NULL").groupBy("tenant_id", "candidate_id").agg(F.max(F.when(F.col("decision") == "REMEMBER", 1).otherwise(0)).alias("kept"))
    sensitive = F.coalesce(F.exists("sensitivity", lambda s: s != "NONE"), F.lit(False))
    kept, n = F.col("kept") == 1, F.count("*")
    return c.join(d, ["tenant_id", "candidate_id"], "left").groupBy("memory_type").agg(
        n.alias("n"), F.count_if(F.col("kept").isNull()).alias("n_missing"), ratio(F.count_if(F.col("kept").isNull()), n).alias("missing_rate"), F.count_if(kept & sensitive).alias("n_harmful"), ratio(F.count_if(kept & sensitive), F.count_if(kept)).alias("harmful_write_rate")
    )


_OR = """SELECT source_event_id, received_at FROM {e} e WHERE deletion_state = 'ERASED' OR EXISTS (SELECT 1 FROM {t} t WHERE t.tenant_id = e.tenant_id AND t.object_id = e.source_event_id)
OR EXISTS (SELECT 1 FROM {c} c WHERE c.tenant_id = e.tenant_id AND c.source_event_id = e.source_event_id AND c.content_state = 'ERASED')"""


@family.query(_OR.format(e="source_event", t="erasure_tombstone", c="memory_candidate"))
def touched_by_erasure(spark: SparkSession, folder: str) -> DataFrame:
    """EXISTS under OR: Catalyst's existence joins."""
    return spark.sql(_OR, e=table(spark, folder, "source_event"), t=table(spark, folder, "erasure_tombstone"), c=table(spark, folder, "memory_candidate"))


@family.query("""WITH s AS (SELECT source_event_id, min(source_id) AS source_id FROM source_event WHERE source_event_id IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT ON (version_id) version_id, source_event_ids AS l FROM memory_search_projection WHERE version_id IS NOT NULL),
x AS (SELECT version_id, unnest(l) AS source_event_id, generate_subscripts(l, 1) AS i FROM p), m AS (SELECT version_id, source_id, min(i) AS i FROM x JOIN s USING (source_event_id) GROUP BY 1, 2)
SELECT version_id, list(source_id ORDER BY i) AS cited FROM m GROUP BY 1""")
def citation_remap(spark: SparkSession, folder: str) -> DataFrame:
    """Cited event ids as source ids, in order of first citation, each once."""
    s = table(spark, folder, "source_event").where("source_event_id IS NOT NULL").groupBy("source_event_id").agg(F.min("source_id").alias("source_id"))
    p = one_of_copies(table(spark, folder, "memory_search_projection", "version_id", "source_event_ids"), "version_id").select("version_id", F.posexplode("source_event_ids").alias("i", "source_event_id"))
    first = p.join(s, "source_event_id").groupBy("version_id", "source_id").agg(F.min("i").alias("i"))
    return first.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("i", "source_id"))).getField("source_id").alias("cited"))


@family.query("""SELECT memory_id, lifecycle_state, updated_at FROM (SELECT DISTINCT ON (memory_id) * FROM memory_lineage WHERE memory_id IS NOT NULL)
ORDER BY CASE lifecycle_state WHEN 'ERASED' THEN 0 WHEN 'ACTIVE' THEN 1 ELSE 2 END, coalesce(updated_at, created_at) NULLS LAST, created_at NULLS LAST, memory_id LIMIT 200""")
def claim_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 by a custom order of states, then time and id: a top-k per task before anything is shuffled."""
    rows = one_of_copies(table(spark, folder, "memory_lineage", "memory_id", "lifecycle_state", "created_at", "updated_at"), "memory_id")
    state = F.when(F.col("lifecycle_state") == "ERASED", 0).when(F.col("lifecycle_state") == "ACTIVE", 1).otherwise(2)
    return rows.orderBy(state, F.coalesce("updated_at", "created_at").asc_nulls_last(), F.col("created_at").asc_nulls_last(), "memory_id").limit(200).select("memory_id", "lifecycle_state", "updated_at")


_MARKS = {"CONTACT": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "IDENTIFIER": r"(passport|tax id|national identity)"}


@family.query("""WITH c AS (SELECT DISTINCT candidate_id, sensitivity, normalized_content AS t FROM memory_candidate WHERE candidate_id IS NOT NULL),
u AS (SELECT candidate_id, list_distinct(coalesce(list_filter(sensitivity, lambda s: s IS NOT NULL), []) || CASE WHEN regexp_matches(coalesce(t, ''), '""" + _MARKS["CONTACT"] + """') THEN ['CONTACT'] ELSE [] END || CASE WHEN regexp_matches(lower(coalesce(t, '')), '""" + _MARKS["IDENTIFIER"] + """') THEN ['IDENTIFIER'] ELSE [] END) AS s FROM c)
SELECT candidate_id, list_sort(CASE WHEN len(s) > 1 THEN list_filter(s, lambda x: x <> 'NONE') ELSE s END) AS sensitivity FROM u""")
def sensitivity_union(spark: SparkSession, folder: str) -> DataFrame:
    """Declared and detected kinds together; NONE goes where there is another."""
    c = table(spark, folder, "memory_candidate", "candidate_id", "sensitivity", "normalized_content").where("candidate_id IS NOT NULL").distinct()
    text, none = F.coalesce("normalized_content", F.lit("")), F.array().cast("array<string>")
    seen = lambda kind, t: F.when(t.rlike(_MARKS[kind]), F.array(F.lit(kind))).otherwise(none)
    every = F.array_distinct(F.concat(F.coalesce(F.array_compact("sensitivity"), none), seen("CONTACT", text), seen("IDENTIFIER", F.lower(text))))
    u = c.select("candidate_id", every.alias("s"))
    return u.select("candidate_id", F.array_sort(F.when(F.size("s") > 1, F.array_remove("s", "NONE")).otherwise(F.col("s"))).alias("sensitivity"))


@family.query("SELECT embedding_model_version, count(*)::BIGINT AS n, sum(4 * coalesce(len(embedding), 0))::BIGINT AS n_bytes FROM memory_search_projection GROUP BY 1")
def vector_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of dense float32 vectors by model."""
    p = table(spark, folder, "memory_search_projection", "embedding_model_version", "embedding")
    return p.groupBy("embedding_model_version").agg(F.count("*").alias("n"), F.sum(4 * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))).alias("n_bytes"))


@family.query("""WITH a AS (SELECT DISTINCT predicate FROM predicate_catalog WHERE predicate_cardinality = 'SET')
SELECT memory_id, predicate, predicate_cardinality, CASE WHEN lower(trim(predicate)) IN (SELECT predicate FROM a) THEN 'SET' ELSE 'SINGLE' END AS allowed FROM (SELECT DISTINCT ON (memory_id) * FROM memory_lineage WHERE memory_id IS NOT NULL)
WHERE predicate_cardinality IS DISTINCT FROM CASE WHEN lower(trim(predicate)) IN (SELECT predicate FROM a) THEN 'SET' ELSE 'SINGLE' END""")
def cardinality_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Lineages whose cardinality is not that of the allow-list: SET for the predicates it names, SINGLE for all others."""
    allow = table(spark, folder, "predicate_catalog").where("predicate_cardinality = 'SET'").select(F.col("predicate").alias("k")).distinct().withColumn("hit", F.lit(True))
    rows = one_of_copies(table(spark, folder, "memory_lineage", "memory_id", "predicate", "predicate_cardinality"), "memory_id").withColumn("k", F.lower(F.trim("predicate")))
    allowed = F.when(F.col("hit"), "SET").otherwise("SINGLE")
    return rows.join(allow, "k", "left").withColumn("allowed", allowed).where(~F.col("predicate_cardinality").eqNullSafe(F.col("allowed"))).select("memory_id", "predicate", "predicate_cardinality", "allowed")


@family.query("""WITH v AS (SELECT DISTINCT ON (version_id) * FROM memory_version WHERE version_id IS NOT NULL), e AS (SELECT tenant_id, source_event_id, min(received_at) AS arrived FROM source_event GROUP BY 1, 2),
s AS (SELECT DISTINCT tenant_id, version_id, projected_at, unnest(source_event_ids) AS source_event_id FROM memory_search_projection),
g AS (SELECT DISTINCT memory_id, truth_status, unnest(source_event_ids) AS i FROM memory_search_projection)
SELECT 'one_tenant_per_lineage' AS rule, count(*)::BIGINT AS n FROM (SELECT memory_id FROM v GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1)
UNION ALL SELECT 'one_lineage_per_version', count(*)::BIGINT FROM (SELECT version_id FROM memory_version WHERE version_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT memory_id) > 1)
UNION ALL SELECT 'no_future_evidence', count(*)::BIGINT FROM s JOIN e USING (tenant_id, source_event_id) WHERE arrived > projected_at
UNION ALL SELECT 'current_and_past_disjoint', count(*)::BIGINT FROM (SELECT memory_id, i FROM g WHERE i IS NOT NULL AND truth_status IN ('CURRENT', 'HISTORICAL') GROUP BY 1, 2 HAVING count(DISTINCT truth_status) > 1)""")
def dataset_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules across rows: a family stays in one split, ids are unique, evidence is not from the future, wanted and forbidden evidence are disjoint."""
    v = table(spark, folder, "memory_version", "version_id", "memory_id", "tenant_id").where("version_id IS NOT NULL")
    p = table(spark, folder, "memory_search_projection", "tenant_id", "version_id", "memory_id", "truth_status", "projected_at", "source_event_ids")
    e = table(spark, folder, "source_event", "tenant_id", "source_event_id", "received_at").groupBy("tenant_id", "source_event_id").agg(F.min("received_at").alias("arrived"))
    future = p.select("tenant_id", "version_id", "projected_at", F.explode("source_event_ids").alias("source_event_id")).distinct().join(e, ["tenant_id", "source_event_id"]).where("arrived > projected_at")
    mixed = p.where(F.col("truth_status").isin("CURRENT", "HISTORICAL")).select("memory_id", "truth_status", F.explode("source_event_ids").alias("i")).where("i IS NOT NULL")
    several = lambda df, keys, c: df.groupBy(*keys).agg(F.countDistinct(c).alias("k")).where("k > 1")
    rules = {
        "one_tenant_per_lineage": several(one_of_copies(v, "version_id"), ["memory_id"], "tenant_id"), "one_lineage_per_version": several(v, ["version_id"], "memory_id"),
        "no_future_evidence": future, "current_and_past_disjoint": several(mixed, ["memory_id", "i"], "truth_status"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in rules.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
