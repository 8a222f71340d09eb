"""Queries of the training-data problems, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoframe.llm import near_duplicates, packing, pii, splitting, tokens, vectors
from mnemoframe.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, folder, "memory_candidate"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Per candidate its class of equal statements, its group of linked ones and its number of links."""
    return near_duplicates.groups(table(spark, folder, "memory_candidate"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The two texts that hold personal data, as (table_name, record_id, text)."""
    parts = (("source_event", "source_event_id", "payload"), ("memory_candidate", "candidate_id", "normalized_content"))
    one, two = (table(spark, folder, t, i, c).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), F.col(c).alias("text")) for t, i, c in parts)
    return one.unionByName(two)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_types(_texts(spark, folder), table(spark, folder, "person_name_token"))


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with personal data: its types and the text with placeholders."""
    return pii.personal_data(_texts(spark, folder), table(spark, folder, "person_name_token"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memory_search_projection", "version_id", "embedding_model_version", "embedding_dimensions", "embedding")
    return vectors.nearest_pairs(rows).select(F.col("a").alias("version_id_a"), F.col("b").alias("version_id_b"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding gives each text again, and how many characters the tokens' offsets cover."""
    return tokens.round_trip(table(spark, folder, "documents"), "doc_id", "text").drop("n_ids")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), table(spark, folder, "token_budget"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "documents"), table(spark, folder, "token_budget"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_masked": p4_masked, "p5_found": p5_found, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p8_pieces": p8_pieces}
_TRIGRAMS = r"""WITH s AS (SELECT DISTINCT candidate_id AS id, lower(trim(predicate)) AS p, trim(regexp_replace(lower(normalized_content), '[^\p{L}\p{N}]+', ' ', 'g')) AS n
  FROM memory_candidate WHERE candidate_id IS NOT NULL AND normalized_content IS NOT NULL AND predicate IS NOT NULL),
g AS (SELECT id, p, list_distinct(list_transform(range(1, length(n) - 1), lambda k: substring(n, k, 3))) AS t FROM s WHERE length(n) >= 3),
j AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS u FROM g a JOIN g b ON a.p = b.p AND a.id < b.id WHERE len(a.t) >= 0.69 * len(b.t) AND len(b.t) >= 0.69 * len(a.t))
SELECT x AS candidate_id_a, y AS candidate_id_b FROM j WHERE i / (u - i) >= 0.7"""
#: Personal data, neighbours, ids, containers and pieces have no SQL: they are tested against brute force, the libraries and by properties.
SQL: dict[str, str] = {
    "p1_found": _TRIGRAMS,
    "p6_round_trip": "SELECT doc_id, length(coalesce(text, ''))::INTEGER AS n_chars, true AS same FROM documents",
}
