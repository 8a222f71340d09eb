from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import hashing, udfs
from mnemoframe.functions.text import squeeze, trimmed_key, xml_escape
from mnemoframe.operators.budget import choose
from mnemoframe.operators.evaluation import strict_f1
from mnemoframe.operators.relational import keyset_page, latest_per_key, optional, upsert_latest
from mnemoframe.operators.retrieval import assemble, cosine, fuse
from mnemoframe.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text", ["", "a", "Grüße 你好", "x" * 300])
def test_hashes(spark, text):
    b = text.encode()
    want = hashlib.sha256(len(b).to_bytes(4, "big") + b + (0).to_bytes(4, "big")).hexdigest()
    assert one(spark, hashing.length_prefixed(F.lit(text), F.lit(None))) == want
    assert one(spark, hashing.nul_joined(F.lit(text), F.lit(None), F.lit("z"))) == hashlib.sha256(b + b"\0\0z").hexdigest()
    assert one(spark, hashing.name_uuid(F.lit(text))) == str(uuid.UUID(bytes=hashlib.md5(b).digest(), version=3))


def test_text(spark):
    assert one(spark, trimmed_key(F.lit("　 AB \n"))) == "ab"
    assert one(spark, trimmed_key(F.lit(" \t"))) is None
    assert one(spark, squeeze(F.lit("  A \n b "))) == "a b"
    assert one(spark, xml_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"


def test_embedder():
    a, b, c = udfs.embed("green tea"), udfs.embed("Green  TEA"), udfs.embed("bicycle")
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and a @ b > a @ c and not udfs.embed("").any()


@pytest.mark.parametrize(("text", "code"), [('{"a": 1}', None), ('{"a": 1, "a": 2}', "DUPLICATE_KEY"), ("{", "NOT_JSON"), ("[" * 9 + "]" * 9, "TOO_DEEP"), ("[NaN]", "BAD_NUMBER"), (json.dumps("x" * 20_000), "STRING_TOO_LONG"), (json.dumps([0] * 2000), "TOO_MANY_NODES"), (" " * 70_000, "TOO_LARGE")])
def test_strict_json(text, code):
    if code is None:
        assert udfs.strict_json(text) == {"a": 1}
        return
    with pytest.raises(udfs.StrictError) as e:
        udfs.strict_json(text)
    assert e.value.code == code


def test_json_differences():
    assert udfs.differences({"a": [1, 2], "b": 1}, {"a": [1, 3, 4], "c": 1}) == ["$.a[1]", "$.a[2]", "$.b", "$.c"]
    assert udfs.differences(1, True) == ["$"] and udfs.differences([], []) == []


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z")], "k string, n int, v string")
    assert {r.v for r in latest_per_key(df, ["k"], F.col("n").desc_nulls_last()).collect()} == {"y", "z"}
    new = spark.createDataFrame([("a", 2, "old"), ("b", 1, "w"), ("c", 1, "c")], df.schema)
    assert {r.v for r in upsert_latest(df, new, ["k"], "n").collect()} == {"y", "w", "c"}
    assert [r.k for r in keyset_page(new, "k", "a", 1).collect()] == ["b", "c"]
    assert optional(df, k="a", v=None).count() == 2


def test_budget_fold_skips_and_goes_on(spark):
    rows = [("s", k, size) for k, size in enumerate([50, 60, 40, 200, 10])] + [("u", 9, None)]
    df = spark.createDataFrame(rows, "session string, item int, size int")
    got = {(r.session, r.item, r.used) for r in choose(df, "session", "item", F.col("size"), 100, -F.col("item")).collect()}
    # order: 0 (50), 1 does not fit, 2 (90), 3 does not, 4 (100)
    assert got == {("s", 0, 50), ("s", 2, 90), ("s", 4, 100), ("u", 9, 0)}
    ranked = spark.createDataFrame([(1, 1, 10, "x" * 50), (1, 2, 11, "x" * 60), (1, 3, 12, "x" * 40), (2, 1, 13, None)], "query_id long, rank int, doc_id long, text string")
    assert {(r.query_id, r.used, tuple(r.chosen), r.truncated) for r in assemble(ranked, 100).collect()} == {(1, 90, (10, 12), True), (2, 0, (13,), False)}


def test_fusion_takes_best_rank_per_source(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 5, 3), (1, 6, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1)], a.schema)
    got = [(r.doc_id, r.n_sources) for r in fuse({"A": a, "B": b}).orderBy("rank").collect()]
    assert got == [(6, 2), (5, 1)]


def test_cosine_and_f1(spark):
    v = lambda *x: F.array(*(F.lit(float(k)) for k in x))
    assert one(spark, F.round(cosine(v(1, 1), v(1, 0)), 6)) == 0.707107 and one(spark, cosine(v(0, 0), v(1, 0))) == 0
    assert one(spark, strict_f1(F.lit(0.0), F.lit(0.0))) is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    files.write_json_lines(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        files.write_json_lines(df, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out"), df.schema).count() == 2
    (tmp_path / "one.json").write_text('{"n": 1,\n "t": "x"}')
    assert files.read_json(spark, str(tmp_path / "one.json"), df.schema).first().t == "x"
    assert "a\\|b" in files.markdown(df, "R")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_bytes(b"{}\r\n")
    sha = hashlib.sha256(b"{}\n").hexdigest()
    (tmp_path / "d/manifest.json").write_text(json.dumps({"files": {"a.json": sha, "b.json": sha}}))
    assert files.verify_manifest(tmp_path / "d") == ["b.json"]
    files.write_partitioned(df, str(tmp_path / "p"), "n")
    assert files.stored_files(spark, str(tmp_path / "p")).count() >= 2
