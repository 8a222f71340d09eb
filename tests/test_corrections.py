"""Commands, receipts, merged state, roll-ups and fences on small cases."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import corrections as C, evaluation as V
from mnemoframe.sources.files import markdown


def test_first_command_of_a_version_applies(spark):
    commands = spark.createDataFrame([("c2", "v1", "INVALIDATE", 5), ("c1", "v1", "CORRECT", 5), ("c3", "v1", "CORRECT", 4), ("c4", "v2", "CORRECT", None), ("c5", "v9", "INVALIDATE", 1), ("c6", None, "CORRECT", 1), ("c7", "v3", "INVALIDATE", 1)], "command_id string, version_id string, kind string, at long")
    state = spark.createDataFrame([("v1", "CURRENT"), ("v2", "CONFLICTED"), ("v3", "INVALIDATED")], "version_id string, status string")
    got = {r.command_id: (r.outcome, r.from_status, r.replacement_id) for r in C.apply_commands(commands, state).collect()}
    name = lambda c: str(uuid.UUID(bytes=__import__("hashlib").md5(c.encode()).digest(), version=3))
    late = ("ALREADY_INVALIDATED", None, None)
    assert got == {"c1": late, "c2": late, "c3": ("APPLIED", "CURRENT", name("c3")), "c4": ("APPLIED", "CONFLICTED", name("c4")), "c5": ("NOT_FOUND", None, None), "c6": ("NOT_FOUND", None, None), "c7": late}
    assert C.apply_commands(commands.limit(0), state).count() == 0


def test_receipts(spark):
    m = spark.createDataFrame([("k", "e1", 1, "a"), ("k", "e2", 2, "a"), ("k", "e3", 3, "b"), ("n", "e4", None, None), ("n", "e5", None, None)], "key string, id string, at long, said string")
    got = {r.id: (r.disposition, r.first_receipt) for r in C.receipts(m, ("key",), ("said",), "id", "at").collect()}
    assert got == {"e1": ("APPLIED", "e1"), "e2": ("IDEMPOTENT_REPLAY", "e1"), "e3": ("CONFLICT", None), "e4": ("APPLIED", "e4"), "e5": ("IDEMPOTENT_REPLAY", "e4")}


def test_merge_takes_the_later_row_whichever_side_it_is_on(spark):
    stored = spark.createDataFrame([("t", "m", "v1", 1, 0, "CURRENT", 1), ("t", "m", "v2", 5, 0, "CURRENT", 5)], "tenant_id string, memory_id string, version_id string, sequence int, ordinal int, status string, since long")
    delta = spark.createDataFrame([("t", "m", "v1", 2, 1, "HISTORICAL", 2), ("t", "m", "v2", 3, 0, "CURRENT", 3), ("t", "m", "v3", 6, 0, "CURRENT", 6)], "tenant_id string, memory_id string, version_id string, sequence int, ordinal int, to_status string, occurred_at long")
    assert {(r.version_id, r.status, r.since) for r in C.merged_state(stored, delta).collect()} == {("v1", "HISTORICAL", 2), ("v2", "CURRENT", 5), ("v3", "CURRENT", 6)}


def test_storage_is_null_unless_complete(spark):
    o = spark.createDataFrame([("a", True, 1, 2), ("a", True, 2, 3), ("b", True, 5, 5), ("b", False, 1, 1)], "t string, complete boolean, c long, v long")
    got = {r.t: tuple(r)[1:] for r in V.storage(o, "t", {"content": "c", "val": "v"}).collect()}
    assert got == {"a": (2, True, 8, 4.0, 3, 5), "b": (2, False, None, None, None, None)}


def test_evidence_and_answers(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "b", "a"], ["b"], ["x"]), (["a"], [], [], []), (["a"], ["a"], ["a", "z"], ["z"])], "g array<string>, r array<string>, s array<string>, f array<string>")
    got = [tuple(r) for r in df.select(*V.evidence_scores(*(F.col(c) for c in "grsf"))).collect()]
    assert got == [(True, True, 0.5, 1.0, 0.666667, False, 1, 1, True, False, "context"), (False, False, 0.0, 0.0, 0.0, False, 0, 0, False, False, "retrieval"), (True, True, 1.0, 1.0, 1.0, True, 1, 2, True, True, "none")]
    a = spark.createDataFrame([("ABSTAIN", [], []), ("ABSTAIN", [], ["x"]), ("SET", ["x", "y"], ["y", "x"]), ("SET", ["x", "y"], ["x"]), ("TEXT", ["x", "y"], ["x"]), ("TEXT", ["x"], ["x", "y"])], "k string, a array<string>, i array<string>")
    assert [r[0] for r in a.select(V.answer_fits(*(F.col(c) for c in "kai"))).collect()] == [True, False, True, False, True, False]
    b = spark.createDataFrame([(["Tea"], ["green tea"]), (["tea"], []), ([], ["x"])], "f array<string>, i array<string>")
    assert [r[0] for r in b.select(V.leaks(F.col("f"), F.col("i"))).collect()] == [True, False, False]


def test_what_is_too_large_is_an_error_not_a_cut(spark):
    with pytest.raises(ValueError, match="30 rows"):
        markdown(spark.range(30), "t", most=29)
    assert markdown(spark.range(30), "t").count("\n") == 34
    with pytest.raises(ValueError, match="1001 rows"):
        V.expansion(spark.range(2), spark.range(1001).toDF("x"), 2)
