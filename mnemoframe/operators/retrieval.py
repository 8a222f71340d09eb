"""Retrieval for many queries at once: vector, lexical, structured and recency candidates, fused by reciprocal rank.

Queries are a table (query_id, embedding, terms, source, lang, ...), the corpus another (doc_id, embedding, tokens, ...).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mnemoframe.operators.relational import top_per_key

RRF_K = 60


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine similarity in double precision; zero if either vector is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _block_topk(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, order = np.unique(docs["doc_id"].to_numpy(), return_index=True)
        x, q = _unit(docs["embedding"])[order], _unit(queries["asked"])
        score = np.round(q @ x.T, 9)
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend: ties go to the smaller
        asked = np.repeat(queries["query_id"].to_numpy(), best.shape[1])
        return pa.table({"query_id": pa.array(asked), "doc_id": pa.array(ids[best.ravel()]), "score": pa.array(np.take_along_axis(score, best, 1).ravel())})

    return run


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, block_docs: int = 20_000, block_queries: int = 2_000) -> DataFrame:
    """The exact k most similar documents of each query: blocks of queries against blocks of the corpus, by matrix product.

    Both counts come from the tables; every pair of blocks is one bounded task and keeps k rows a query, then these are merged.
    """
    n_docs, n_queries = (max(1, -(-df.count() // b)) for df, b in ((corpus, block_docs), (queries, block_queries)))
    d = corpus.select(F.col("doc_id").alias("doc_id"), F.col("embedding").alias("embedding")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_docs))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    q = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("asked")).withColumn("other", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_docs - 1).cast("long"))))
    part = d.groupBy("block", "other").cogroup(q.groupBy("block", "other")).applyInArrow(_block_topk(k), "query_id long, doc_id long, score double")
    return top_per_key(part, ["query_id"], k, F.desc("score"), F.asc("doc_id"))


def words(text: F.Column) -> F.Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def lexemes(text: F.Column) -> F.Column:
    """Lower-case runs of letters, marks and digits of any script, in order; each Han character is one of its own."""
    apart = F.regexp_replace(F.lower(text), r"(\p{IsHan})", " $1 ")
    return F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, tokenise: Callable[[F.Column], F.Column] = words) -> DataFrame:
    """Documents that hold all terms of a query, by term occurrences over one plus the logarithm of their length.

    Candidates come from each query's rarest term only, so a term in a third of all documents is never joined on unless
    nothing rarer is asked for; no document matches a query without terms.
    """
    docs = corpus.select("doc_id", tokenise(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens")).where("n_tokens > 0")
    terms = queries.select("query_id", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    asked = terms.select("query_id", F.explode("terms").alias("term"))
    # only postings of terms that some query asks for are counted and joined
    postings = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    known = asked.join(df, "term", "left")
    rarest = known.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r")).where("r.df > 0").select("query_id", F.col("r.term").alias("term"))
    found = rarest.join(postings, "term").join(terms, "query_id").join(docs, "doc_id").where(F.size(F.array_except("terms", "tokens")) == 0)
    # a text that asks for itself or a copy has no other tokens, so the terms need not be counted one by one
    same = F.size(F.array_distinct("tokens")) == F.size("terms")
    hits = F.when(same, F.col("n_tokens")).otherwise(F.size(F.filter("tokens", lambda t: F.array_contains(F.col("terms"), t))))
    scored = found.select("query_id", "doc_id", F.round(hits / (1 + F.log(F.col("n_tokens").cast("double"))), 9).alias("score"))
    return top_per_key(scored, ["query_id"], k, F.desc("score"), F.asc("doc_id"))


def structured_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Score 1.0 for an equal source, else 0.8 for an equal language. Only the k first documents of each value are joined."""
    w = lambda c: Window.partitionBy(c).orderBy(F.col("recorded_at").desc_nulls_last(), "doc_id")
    parts = []
    for c, score in (("source", 1.0), ("lang", 0.8)):
        some = corpus.where(F.col(c).isNotNull()).select(c, "doc_id", "recorded_at").withColumn("_n", F.row_number().over(w(c))).where(F.col("_n") <= 2 * k).drop("_n")
        parts.append(queries.select("query_id", c).join(some, c).select("query_id", "doc_id", "recorded_at", F.lit(score).alias("score")))
    best = parts[0].unionByName(parts[1]).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max("recorded_at").alias("recorded_at"))
    return top_per_key(best, ["query_id"], k, F.desc("score"), F.col("recorded_at").desc_nulls_last(), F.asc("doc_id")).drop("recorded_at")


def recent_topk(queries: DataFrame, corpus: DataFrame, k: int, at: F.Column) -> DataFrame:
    """The k latest documents recorded up to ``at``, the same for all queries: k rows, so the product stays bounded."""
    last = corpus.where(F.col("recorded_at") <= at).select("doc_id", "recorded_at").orderBy(F.desc("recorded_at"), "doc_id").limit(k)
    ranked = last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("recorded_at"), "doc_id")))
    return queries.select("query_id").join(F.broadcast(ranked), F.lit(True)).select("query_id", "doc_id", F.lit(1.0).alias("score"), "rank")


def fuse(sources: dict[str, DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: per document the sum of 1 / (k + best rank) over the sources that found it."""
    parts = [df.select("query_id", "doc_id", F.lit(name).alias("component"), "rank") for name, df in sorted(sources.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("query_id", "doc_id", "component").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def assemble(ranked: DataFrame, budget: int) -> DataFrame:
    """Context of each query within a budget of characters: items in rank order, one that does not fit is skipped and the next tried.

    A fold in the JVM over the few ranked items of a query (query_id, rank, doc_id, text).
    """
    items = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("chosen"), F.lit(False).alias("truncated"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        fits = acc["used"] + x["size"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["chosen"], F.array(x["doc_id"]))).otherwise(acc["chosen"]).alias("chosen"),
            (acc["truncated"] | ~fits).alias("truncated"),
        )

    return items.select("query_id", F.aggregate("items", start, step).alias("c")).select("query_id", "c.*")
