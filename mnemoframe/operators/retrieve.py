"""Retrieval over versioned memories: gate, intent, sources by intent, scoped candidates, fusion, and the context of evidence.

Queries are a table (query_id, tenant_id, user_id, agent_id, text, predicate, label, model, unit vector), as are the memories. Both meet
by scope only; a scope's memories are spread over salts, so one that holds a third of all rows is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.functions.text import WHITE_SPACE, xml_escape
from mnemoframe.functions.time import valid_at
from mnemoframe.operators.relational import top_per_key
from mnemoframe.operators.retrieval import RRF_K, lexemes

# Texts that need no memory, the gate's codes, and the terms of change and of history.
GREETINGS = ("hi", "hello", "thanks", "thank you", "你好", "谢谢", "早上好", "晚上好")
EMPTY, CONVERSATIONAL, REQUIRED = "EMPTY_QUERY", "CONVERSATIONAL_NO_MEMORY_NEED", "MEMORY_RETRIEVAL_REQUIRED"
CHANGE_TERMS = ("changed", "change", "moved", "previous", "before and after", "变化", "改变", "搬家", "前后")
HISTORY_TERMS = ("used to", "formerly", "previously", "at that time", "过去", "以前", "当时", "曾经")
OPEN, CLOSE = '<memory-evidence trust="untrusted-data">\n', "</memory-evidence>"

SCOPE = ("tenant_id", "user_id", "agent_id")


def gate(text: Column) -> Column:
    """Whether a query needs memory at all, as a code; null counts as empty."""
    said = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE)))
    return F.when(said == "", EMPTY).when(said.isin(*GREETINGS), CONVERSATIONAL).otherwise(REQUIRED)


def intent(text: Column) -> Column:
    """CHANGE before HISTORICAL before PRESENT, by the terms a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda terms: reduce(Column.__or__, (F.contains(low, F.lit(t)) for t in terms))
    return F.when(some(CHANGE_TERMS), "CHANGE").when(some(HISTORY_TERMS), "HISTORICAL").otherwise("PRESENT")


def asked_time(text: Column) -> Column:
    """Midnight of the first ISO date in a text; null if there is none or it is no date."""
    day = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![0-9])(\d{4}-\d{2}-\d{2})(?![0-9])", 1)
    return F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def unit(v: Column) -> Column:
    """The vector in double precision over its length; null if it is null, empty, zero or not finite."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(wide, lambda x: x / norm))


def visible(kind: Column, at: Column, status: Column, start: Column, end: Column) -> Column:
    """Never INVALIDATED; for the present CURRENT or CONFLICTED only; with a time asked for, valid then."""
    now = (kind != "PRESENT") | status.isin("CURRENT", "CONFLICTED")
    return (status != "INVALIDATED") & now & (at.isNull() | valid_at(start, end, at))


def candidates(queries: DataFrame, memories: DataFrame, limit: int, salts: int = 16) -> DataFrame:
    """Rows (query_id, version_id, component, score, rank) of the sources that each query's intent selects, ``limit`` a source.

    VECTOR compares vectors of one model and length, LEXICAL wants all terms, STRUCTURED the predicate (1.0) or the label (0.8), TEMPORAL
    runs for a past intent or an asked time only. Gated queries have no rows.
    """
    q = queries.where(gate(F.col("text")) == REQUIRED).select(
        "query_id", *SCOPE, intent(F.col("text")).alias("kind"), asked_time(F.col("text")).alias("at"), F.array_distinct(F.coalesce(lexemes(F.col("text")), F.array().cast("array<string>"))).alias("terms"),
        F.col("predicate").alias("q_predicate"), F.lower("label").alias("q_label"), F.col("model").alias("q_model"), F.col("unit").alias("q_unit"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    m = memories.select(
        "version_id", *SCOPE, "status", "valid_time_start", "valid_time_end", "recorded_at", lexemes(F.col("content")).alias("tokens"), "predicate", F.lower("label").alias("label"), "model", "unit",
        F.pmod(F.xxhash64("version_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    both = q.join(m, [*SCOPE, "salt"]).where(visible(F.col("kind"), F.col("at"), F.col("status"), F.col("valid_time_start"), F.col("valid_time_end")))
    dot = F.aggregate(F.zip_with("q_unit", "unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    alike = (F.col("q_model") == F.col("model")) & (F.size("q_unit") == F.size("unit"))
    n = F.size("tokens")
    holds = (F.size("terms") > 0) & (n > 0) & (F.size(F.array_except("terms", "tokens")) == 0)
    hits = F.size(F.filter("tokens", lambda t: F.array_contains(F.col("terms"), t)))
    scores = {
        "VECTOR": F.when(alike, F.round(dot, 9)),
        "LEXICAL": F.when(holds, F.round(hits / (1 + F.log(n.cast("double"))), 9)),
        "STRUCTURED": F.when(F.col("q_predicate") == F.col("predicate"), 1.0).when(F.col("q_label") == F.col("label"), 0.8),
        "TEMPORAL": F.when((F.col("kind") != "PRESENT") | F.col("at").isNotNull(), 1.0),
    }
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), s.cast("double").alias("score")) for c, s in scores.items())))
    long = both.select("query_id", "version_id", "recorded_at", each.alias("s")).select("query_id", "version_id", "recorded_at", "s.*").where("score IS NOT NULL")
    recent = F.when(F.col("component") == "TEMPORAL", F.col("recorded_at"))
    return top_per_key(long, ["query_id", "component"], limit, F.desc("score"), recent.desc_nulls_last(), F.asc("version_id"))


def fused(found: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion; ties go to the later recorded and then the smaller id. Adds each memory's columns."""
    sums = found.groupBy("query_id", "version_id").agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("fused_score"), F.count("*").alias("n_sources"), F.first("recorded_at").alias("recorded_at"))
    best = top_per_key(sums, ["query_id"], limit, F.desc("fused_score"), F.col("recorded_at").desc_nulls_last(), F.asc("version_id"))
    return best.drop("recorded_at").join(memories.select("version_id", "memory_id", "status", "predicate", "sources", "content"), "version_id")


def evidence(memory_id: Column, version_id: Column, status: Column, predicate: Column, sources: Column, content: Column) -> Column:
    """One memory as an element; content and predicate are escaped, sources sorted. Nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    ids = F.array_join(F.array_sort(F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != ""))), ",")
    parts = ('  <memory id="', text(memory_id), '" version-id="', text(version_id), '" status="', text(status), '" predicate="', xml_escape(text(predicate)), '" source-event-ids="', ids, '">', xml_escape(text(content)), "</memory>\n")
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def contexts(ranked: DataFrame, budget: int) -> DataFrame:
    """Per query the evidence within a budget of characters, the envelope included.

    In order of rank: at most one version of a lineage, two where the version is CONFLICTED; what does not fit is skipped, marked as
    ``truncated``, and the next is tried. Only the few ranked rows of a query are folded.
    """
    if budget < len(OPEN) + len(CLOSE):
        raise ValueError("the budget cannot hold the envelope")
    item = F.struct("rank", "memory_id", "version_id", "status", evidence(*(F.col(c) for c in ("memory_id", "version_id", "status", "predicate", "sources", "content"))).alias("text"))
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(len(OPEN) + len(CLOSE)).alias("used"), F.array().cast("array<struct<memory_id:string,version_id:string>>").alias("chosen"), F.lit(OPEN).alias("text"), F.lit(False).alias("truncated"))

    def step(acc: Column, x: Column) -> Column:
        same = F.size(F.filter(acc["chosen"], lambda c: c["memory_id"].eqNullSafe(x["memory_id"])))
        allowed = same < F.when(x["status"] == "CONFLICTED", 2).otherwise(1)
        fits = acc["used"] + F.length(x["text"]) <= budget
        take = allowed & fits
        return F.struct(
            F.when(take, acc["used"] + F.length(x["text"])).otherwise(acc["used"]).alias("used"),
            F.when(take, F.array_append(acc["chosen"], F.struct(x["memory_id"].alias("memory_id"), x["version_id"].alias("version_id")))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(take, F.concat(acc["text"], x["text"])).otherwise(acc["text"]).alias("text"),
            (acc["truncated"] | (allowed & ~fits)).alias("truncated"),
        )

    folded = rows.select("query_id", F.size("items").alias("n_ranked"), F.aggregate("items", start, step).alias("c"))
    return folded.select("query_id", "n_ranked", F.col("c.used").alias("used"), F.col("c.chosen.version_id").alias("chosen"), F.concat("c.text", F.lit(CLOSE)).alias("rendered"), F.col("c.truncated").alias("truncated"))


def raw_turns(queries: DataFrame, memories: DataFrame, limit: int, salts: int = 16) -> DataFrame:
    """The baseline without lineages: of a scope's rows recorded up to the query's own time, the most similar ones, earlier ones first among equals."""
    q = queries.select("query_id", *SCOPE, F.col("recorded_at").alias("cutoff"), F.col("model").alias("q_model"), F.col("unit").alias("q_unit"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    m = memories.select("version_id", *SCOPE, "recorded_at", "model", "unit", F.pmod(F.xxhash64("version_id"), F.lit(salts)).cast("int").alias("salt"))
    both = q.join(m, [*SCOPE, "salt"]).where((F.col("recorded_at") <= F.col("cutoff")) & (F.col("q_model") == F.col("model")) & (F.size("q_unit") == F.size("unit")))
    score = F.round(F.aggregate(F.zip_with("q_unit", "unit", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)
    ranked = top_per_key(both.select("query_id", "version_id", "recorded_at", score.alias("score")), ["query_id"], limit, F.desc("score"), F.asc("recorded_at"), F.asc("version_id"))
    return ranked.select("query_id", "version_id", "score", "rank")


def same_permutation(before: Column, after: Column) -> Column:
    """Whether a reordering holds the same ids, each once."""
    return (F.size(after) == F.size(F.array_distinct(after))) & (F.array_sort(before) == F.array_sort(after))
