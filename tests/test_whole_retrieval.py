"""Retrieval over tables of which only some ids stand in both."""

from __future__ import annotations

from datetime import datetime

import pytest

from mnemoframe.plans import retrieval as Q


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("few"))
    docs = [(50, "green tea", "en", "web"), (51, "green tea leaves", "en", "web"), (150, "black coffee", "de", "mail"), (151, "Black coffee beans", "de", "mail")]
    spark.createDataFrame([(*r, datetime(2025, 1, k + 1)) for k, r in enumerate(docs)], "doc_id long, text string, lang string, source string, created_at timestamp_ntz").write.parquet(f"{at}/documents.parquet")
    vectors = [(50, [1.0, 0.0], 1), (100, [0.0, 1.0], 2), (101, [0.1, 1.0], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_each_source_sees_its_whole_table(spark, few):
    assert pairs(Q.vector_topk(spark, few)) == {(q, d) for q in (50, 100) for d in (50, 100, 101)}
    assert pairs(Q.lexical_topk(spark, few)) == {(50, 50), (50, 51), (150, 150), (150, 151)}
    assert pairs(Q.structured_topk(spark, few)) == {(50, 50), (50, 51), (150, 150), (150, 151)}
    assert pairs(Q.temporal_topk(spark, few)) == {(q, d) for q in (50, 150) for d in (50, 51, 150, 151)}
    assert {q for q, _ in pairs(Q.rrf_fusion(spark, few))} == {50, 100, 150}
    assert {q.query_id: set(q.chosen) for q in Q.context_budget(spark, few).collect()}[100] == {50, 100, 101}
    assert Q.retrieval_metrics(spark, few).first().n_queries == 2


def test_words_of_all_scripts_and_the_whole_text_are_asked(spark, tmp_path):
    docs = [(50, "Straße nach Köln"), (51, "die Straße nach Köln"), (52, "Straße nach Bonn"), (100, "绿茶 green"), (101, "green 喝绿茶"), (102, "绿 green"), (150, "año nuevo feliz"), (151, "año nuevo"), (200, "!?"), (250, None)]
    spark.createDataFrame([(*r, "x", "s", None) for r in docs], "doc_id long, text string, lang string, source string, created_at timestamp_ntz").write.parquet(str(tmp_path / "documents.parquet"))
    assert pairs(Q.lexical_topk(spark, str(tmp_path))) == {(50, 50), (50, 51), (100, 100), (100, 101), (150, 150)}
