"""Retrieval over memory_search_projection: every version whose id's last byte is divisible by 50 asks, in its own scope, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.operators import retrieve as R
from mnemoframe.operators.relational import one_of_copies
from mnemoframe.plans.family import Family
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL
LIMIT, COMPONENT, BUDGET = 8, 40, 1600


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """Active memories, one row a version; the label is its lineage's."""
    names = ("version_id", "memory_id", "tenant_id", "user_id", "agent_id", "predicate", "truth_status", "normalized_content", "valid_time_start", "valid_time_end", "recorded_at", "source_event_ids", "embedding_model_version", "embedding")
    p = one_of_copies(table(spark, folder, "memory_search_projection", *names), "version_id")
    active = table(spark, folder, "memory_lineage").where("lifecycle_state = 'ACTIVE'").groupBy("tenant_id", "memory_id").agg(F.min("subject_label").alias("label"))
    renamed = p.withColumnsRenamed({"truth_status": "status", "normalized_content": "content", "source_event_ids": "sources", "embedding_model_version": "model"})
    return renamed.withColumn("unit", R.unit(F.col("embedding"))).drop("embedding").join(active, ["tenant_id", "memory_id"])


def asking(m: DataFrame) -> DataFrame:
    last_byte = F.conv(F.right("version_id", F.lit(2)), 16, 10).cast("int")
    return m.where(last_byte % 50 == 0).withColumnsRenamed({"version_id": "query_id", "content": "text"})


def text_list(*terms: str) -> str:
    return ", ".join(f"'{t}'" for t in terms)


_TERMS = r"list_distinct(coalesce(regexp_extract_all(regexp_replace(lower({0}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+'), []))"
_TOKENS = r"regexp_extract_all(regexp_replace(lower({0}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+')"
_WHITE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8195)||chr(12288)"
GATE = f"CASE WHEN trim(coalesce({{0}}, ''), {_WHITE}) = '' THEN '{R.EMPTY}' WHEN lower(trim({{0}}, {_WHITE})) IN ({text_list(*R.GREETINGS)}) THEN '{R.CONVERSATIONAL}' ELSE '{R.REQUIRED}' END"
INTENT = f"CASE WHEN len(list_filter([{text_list(*R.CHANGE_TERMS)}], lambda t: contains(lower(coalesce({{0}}, '')), t))) > 0 THEN 'CHANGE' WHEN len(list_filter([{text_list(*R.HISTORY_TERMS)}], lambda t: contains(lower(coalesce({{0}}, '')), t))) > 0 THEN 'HISTORICAL' ELSE 'PRESENT' END"
DAY = r"try_strptime(nullif(regexp_extract(coalesce({0}, ''), '(^|[^0-9])(\d{{4}}-\d{{2}}-\d{{2}})([^0-9]|$)', 2), ''), '%Y-%m-%d')"

FOUND = f"""WITH l AS (SELECT tenant_id, memory_id, min(subject_label) AS label FROM memory_lineage WHERE lifecycle_state = 'ACTIVE' GROUP BY 1, 2),
m AS (SELECT p.version_id, p.memory_id, p.tenant_id, p.user_id, p.agent_id, p.predicate, truth_status AS status, normalized_content AS content, valid_time_start, valid_time_end, recorded_at, source_event_ids AS sources,
  embedding_model_version AS model, embedding::DOUBLE[] AS e, label FROM (SELECT DISTINCT ON (version_id) * FROM memory_search_projection WHERE version_id IS NOT NULL) p JOIN l ON p.tenant_id = l.tenant_id AND p.memory_id = l.memory_id),
n AS (SELECT * REPLACE (list_transform(coalesce(e, []), lambda x: coalesce(x, 0)) AS e), coalesce(len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0, false) AS ok, {_TOKENS.format('content')} AS tokens FROM m),
q AS (SELECT version_id AS query_id, tenant_id, user_id, agent_id, content AS text, predicate, label, model, e, ok, recorded_at AS cutoff, {INTENT.format('content')} AS kind, {DAY.format('content')} AS asked_at, {_TERMS.format('content')} AS terms
  FROM n WHERE ('0x' || right(version_id, 2))::INTEGER % 50 = 0),
b AS (SELECT q.query_id, n.*, kind, asked_at, terms, q.predicate AS qp, q.label AS ql, q.model AS qm, q.e AS qe, q.ok AND n.ok AS both_ok FROM q JOIN n USING (tenant_id, user_id, agent_id) WHERE {GATE.format('text')} = '{R.REQUIRED}' AND status <> 'INVALIDATED'
  AND (kind <> 'PRESENT' OR status IN ('CURRENT', 'CONFLICTED')) AND (asked_at IS NULL OR ((valid_time_start IS NULL OR valid_time_start <= asked_at) AND (valid_time_end IS NULL OR valid_time_end > asked_at)))),
s AS (SELECT query_id, version_id, recorded_at, 'VECTOR' AS component, CASE WHEN both_ok AND qm = model AND len(qe) = len(e) THEN round(list_cosine_similarity(qe, e), 9) END AS score FROM b
  UNION ALL SELECT query_id, version_id, recorded_at, 'LEXICAL', CASE WHEN len(terms) > 0 AND len(tokens) > 0 AND list_has_all(tokens, terms) THEN round(len(list_filter(tokens, lambda t: list_contains(terms, t))) / (1 + ln(len(tokens))), 9) END FROM b
  UNION ALL SELECT query_id, version_id, recorded_at, 'STRUCTURED', CASE WHEN qp = predicate THEN 1.0 WHEN lower(ql) = lower(label) THEN 0.8 END FROM b
  UNION ALL SELECT query_id, version_id, recorded_at, 'TEMPORAL', CASE WHEN kind <> 'PRESENT' OR asked_at IS NOT NULL THEN 1.0 END FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, component ORDER BY score DESC, CASE WHEN component = 'TEMPORAL' THEN recorded_at END DESC NULLS LAST, version_id) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= {COMPONENT}),
f AS (SELECT query_id, version_id, round(sum(1 / (60 + rank)), 9) AS fused_score, count(*)::BIGINT AS n_sources, any_value(recorded_at) AS recorded_at FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, recorded_at DESC NULLS LAST, version_id) AS rank FROM f QUALIFY rank <= {LIMIT})
"""
_ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ITEM = f"""'  <memory id="' || memory_id || '" version-id="' || version_id || '" status="' || coalesce(status, '') || '" predicate="' || {_ESC.format('predicate')} || '" source-event-ids="' ||
  array_to_string(list_sort(list_filter(coalesce(sources, []), lambda s: s IS NOT NULL AND trim(s) <> '')), ',') || '">' || {_ESC.format('content')} || '</memory>' || chr(10)"""


@family.query(f"""WITH t AS (SELECT DISTINCT source_event_id, json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.content') AS q FROM source_event)
SELECT source_event_id, {GATE.format('q')} AS gate, {INTENT.format('q')} AS intent, {DAY.format('q')} AS asked FROM t""")
def query_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Gate, temporal intent and asked time of every event's text."""
    e = table(spark, folder, "source_event", "source_event_id", "payload").distinct()
    q = e.select("source_event_id", F.when(F.try_parse_json("payload").isNotNull(), F.get_json_object("payload", "$.content")).alias("q")).distinct()
    return q.select("source_event_id", R.gate(F.col("q")).alias("gate"), R.intent(F.col("q")).alias("intent"), R.asked_time(F.col("q")).alias("asked"))


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    m = memories(spark, folder)
    return R.fused(R.candidates(asking(m), m, COMPONENT), m, LIMIT)


@family.query(FOUND + "SELECT query_id, version_id, component, score, rank FROM c")
def scoped_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of the sources that each query's intent selects."""
    m = memories(spark, folder)
    return R.candidates(asking(m), m, COMPONENT).select("query_id", "version_id", "component", "score", F.col("rank").cast("bigint").alias("rank"))


@family.query(FOUND + "SELECT query_id, r.version_id, memory_id, fused_score, n_sources, rank FROM r JOIN m USING (version_id)")
def retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """Gate, intent, sources, fusion and limit in one plan."""
    return ranked(spark, folder).select("query_id", "version_id", "memory_id", "fused_score", "n_sources", F.col("rank").cast("bigint").alias("rank"))


@family.query(FOUND + f""", i AS (SELECT query_id, rank, memory_id, version_id, status, {_ITEM} AS item FROM r JOIN m USING (version_id)),
g AS (SELECT query_id, count(*)::INTEGER AS n_ranked, list({{'used': length(item)::INTEGER, 'mem': [memory_id], 'chosen': [version_id], 'text': item, 'cap': CASE WHEN status = 'CONFLICTED' THEN 2 ELSE 1 END, 'truncated': false}} ORDER BY rank) AS items FROM i GROUP BY 1),
z AS (SELECT query_id, n_ranked, list_reduce(items, lambda acc, x: CASE WHEN len(list_filter(acc.mem, lambda y: y = x.mem[1])) >= x.cap THEN acc
    WHEN acc.used + x.used <= {BUDGET} THEN {{'used': acc.used + x.used, 'mem': acc.mem || x.mem, 'chosen': acc.chosen || x.chosen, 'text': acc.text || x.text, 'cap': 0, 'truncated': acc.truncated}}
    ELSE {{'used': acc.used, 'mem': acc.mem, 'chosen': acc.chosen, 'text': acc.text, 'cap': 0, 'truncated': true}} END,
  {{'used': {len(R.OPEN) + len(R.CLOSE)}::INTEGER, 'mem': []::VARCHAR[], 'chosen': []::VARCHAR[], 'text': '<memory-evidence trust="untrusted-data">' || chr(10), 'cap': 0, 'truncated': false}}) AS a FROM g)
SELECT query_id, n_ranked, a.used AS used, a.chosen AS chosen, a.text || '{R.CLOSE}' AS rendered, a.truncated AS truncated FROM z""")
def evidence_context(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered evidence of each query within 1,600 characters, at most one version a lineage, two of a conflict."""
    return R.contexts(ranked(spark, folder), BUDGET)


@family.query(FOUND + f"""SELECT query_id, version_id, score, rank FROM (SELECT query_id, n.version_id, round(list_cosine_similarity(q.e, n.e), 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recorded_at, n.version_id) AS rank FROM q JOIN n USING (tenant_id, user_id, agent_id) WHERE recorded_at <= cutoff AND q.ok AND n.ok AND q.model = n.model AND len(q.e) = len(n.e)) WHERE rank <= {LIMIT}""")
def raw_turn_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The raw-turn baseline: similar rows up to the query's own time, whatever their lineage or status."""
    m = memories(spark, folder)
    return R.raw_turns(asking(m), m, LIMIT).withColumn("rank", F.col("rank").cast("bigint"))


@family.query(FOUND + """, g AS (SELECT query_id, list(version_id ORDER BY fused_score DESC, version_id) AS before, list(version_id ORDER BY n_sources DESC, version_id) AS after FROM r GROUP BY 1)
SELECT query_id, len(before)::INTEGER AS n, len(after) = len(list_distinct(after)) AND list_sort(before) = list_sort(after) AS applied FROM g""")
def rerank_check(spark: SparkSession, folder: str) -> DataFrame:
    """A reordering by number of sources counts only if it is a permutation of what was ranked."""
    lists = ranked(spark, folder).groupBy("query_id").agg(F.collect_list(F.struct((-F.col("fused_score")).alias("k"), "version_id")).alias("x"), F.collect_list(F.struct((-F.col("n_sources")).alias("k"), "version_id")).alias("y"))
    ids = lists.select("query_id", F.col("x").getField("version_id").alias("x"), F.array_sort("y").getField("version_id").alias("y"))
    return ids.select("query_id", F.size("x").alias("n"), R.same_permutation(F.col("x"), F.col("y")).alias("applied"))
