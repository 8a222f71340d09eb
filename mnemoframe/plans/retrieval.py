"""Retrieval queries over all rows: the vector source searches the whole embeddings table, the other sources the whole documents table, each
asked by every row of its table whose id is divisible by 50, the lexical one with the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.operators import retrieval as R
from mnemoframe.plans.family import Family
from mnemoframe.plans.history import ntz
from mnemoframe.sources.tables import table

family = Family()
QUERIES, SQL = family.QUERIES, family.SQL
K, COMPONENT, AT = 8, 40, "2025-09-01 00:00:00"

def wide(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


WHOLE = r"""WITH docs AS (SELECT doc_id, text, lang, source, created_at AS recorded_at FROM documents),
vectors AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS embedding FROM embeddings),
queries AS (SELECT doc_id AS query_id, list_distinct(coalesce(regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+'), [])) AS terms, source, lang FROM docs WHERE doc_id % 50 = 0),
vec AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT q.doc_id AS query_id, c.doc_id, round(list_cosine_similarity(q.embedding, c.embedding), 9) AS score FROM vectors q, vectors c WHERE q.doc_id % 50 = 0) QUALIFY rank <= 40),
doc AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+') AS tokens FROM docs),
lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round(len(list_filter(tokens, lambda t: list_contains(terms, t))) / (1 + ln(len(tokens))), 9) AS score FROM queries, doc
   WHERE len(terms) > 0 AND list_has_all(tokens, terms)) QUALIFY rank <= 40),
str AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recorded_at DESC NULLS LAST, doc_id) AS rank FROM
  (SELECT query_id, doc_id, recorded_at, CASE WHEN q.source = c.source THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM queries q JOIN docs c ON q.source = c.source OR q.lang = c.lang) QUALIFY rank <= 40),
rec AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score, rank FROM queries, (SELECT doc_id, row_number() OVER (ORDER BY recorded_at DESC, doc_id) AS rank FROM docs WHERE recorded_at <= TIMESTAMP '2025-09-01 00:00:00' QUALIFY rank <= 40)),
parts AS (SELECT query_id, doc_id, rank FROM vec UNION ALL SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM str UNION ALL SELECT query_id, doc_id, rank FROM rec),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, count(*)::BIGINT AS n_sources FROM parts GROUP BY 1, 2))
"""


def measured(ranked: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), "label")
    wanted = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted"))
    r = ranked.join(labels, "doc_id").join(wanted, "query_id")
    good = (F.col("label") == F.col("wanted")) & (F.col("doc_id") != F.col("query_id"))
    per = r.groupBy("query_id").agg(F.min(F.when(good, F.col("rank"))).alias("first"), F.count_if(good).alias("hits"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 9).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.round(F.avg(F.col("hits") / 8.0), 9).alias("context_precision"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", "lang", "source", F.col("created_at").alias("recorded_at"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", F.col("vec_id").alias("doc_id"), "embedding")


def asking_documents(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.array_distinct(F.coalesce(R.lexemes(F.col("text")), F.array().cast("array<string>"))).alias("terms"), "source", "lang")


def asking_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "embedding")


@family.query(WHOLE + "SELECT * FROM vec WHERE rank <= 8")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = embeddings(spark, folder)
    return wide(R.vector_topk(asking_vectors(vectors), vectors, K))


@family.query(WHOLE + "SELECT * FROM lex WHERE rank <= 8")
def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return wide(R.lexical_topk(asking_documents(docs), docs, K, R.lexemes))


@family.query(WHOLE + "SELECT * FROM str WHERE rank <= 8")
def structured_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return wide(R.structured_topk(asking_documents(docs), docs, K))


@family.query(WHOLE + "SELECT * FROM rec WHERE rank <= 8")
def temporal_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return wide(R.recent_topk(asking_documents(docs), docs, K, ntz(AT)))


def hybrid(spark: SparkSession, folder: str, limit: int | None = K) -> DataFrame:
    """Fused over the union: an id that asks in one table only has the candidates of that table's sources."""
    docs, vectors = documents(spark, folder), embeddings(spark, folder)
    q = asking_documents(docs)
    found = {"VECTOR": R.vector_topk(asking_vectors(vectors), vectors, COMPONENT), "LEXICAL": R.lexical_topk(q, docs, COMPONENT, R.lexemes), "STRUCTURED": R.structured_topk(q, docs, COMPONENT), "TEMPORAL": R.recent_topk(q, docs, COMPONENT, ntz(AT))}
    return R.fuse(found, limit=limit)


@family.query(WHOLE + "SELECT * FROM fused WHERE rank <= 8")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return wide(hybrid(spark, folder))


@family.query(WHOLE + """, l AS (SELECT query_id, list({'used': coalesce(length(text), 0)::INTEGER, 'chosen': [f.doc_id], 'truncated': false} ORDER BY rank) AS items FROM fused f LEFT JOIN documents d ON f.doc_id = d.doc_id WHERE rank <= 8 GROUP BY 1),
r AS (SELECT query_id, list_reduce(items, lambda acc, x: CASE WHEN acc.used + x.used <= 1200 THEN {'used': acc.used + x.used, 'chosen': acc.chosen || x.chosen, 'truncated': acc.truncated}
  ELSE {'used': acc.used, 'chosen': acc.chosen, 'truncated': true} END, {'used': 0::INTEGER, 'chosen': []::BIGINT[], 'truncated': false}) AS r FROM l)
SELECT query_id, r.used AS used, r.chosen AS chosen, r.truncated AS truncated FROM r""")
def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Items chosen within 1,200 characters a query; an embedding without a document counts as an empty text, as a null text does."""
    texts = table(spark, folder, "documents", "doc_id", "text")
    return R.assemble(hybrid(spark, folder).join(texts, "doc_id", "left"), 1200)


@family.query(WHOLE + """, gold AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
hit AS (SELECT v.query_id, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS first, count(g.doc_id) AS hits FROM vec v LEFT JOIN gold g ON v.query_id = g.query_id AND v.doc_id = g.doc_id WHERE rank <= 8 GROUP BY 1)
SELECT count(*)::BIGINT AS n_queries, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr, round(avg(hits / 8.0), 9) AS context_precision FROM hit""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return measured(vector_topk(spark, folder), spark, folder)
