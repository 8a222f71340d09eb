"""Gate, intent, sources, evidence and lineage caps on small cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import retrieve as R

D = lambda d: datetime(2025, 1, d)
MEMORY = "version_id string, memory_id string, tenant_id string, user_id string, agent_id string, status string, valid_time_start timestamp_ntz, valid_time_end timestamp_ntz, recorded_at timestamp_ntz, content string, predicate string, label string, model string, unit array<double>, sources array<string>"
QUERY = "query_id string, tenant_id string, user_id string, agent_id string, text string, predicate string, label string, model string, unit array<double>, recorded_at timestamp_ntz"


def test_gate_intent_and_time(spark):
    rows = [(None,), (" 　\t",), ("  HELLO ",), ("谢谢",), ("hello there",), ("What changed?",), ("I used to",), ("they moved, formerly",), ("以前住哪", ), ("on 2025-02-03 please",), ("on 2025-02-30",), ("12025-02-03",), ("x2025-02-03x",)]
    df = spark.createDataFrame(rows, "t string")
    got = [(r.g, r.i, r.d and r.d.isoformat()[:10]) for r in df.select(R.gate(F.col("t")).alias("g"), R.intent(F.col("t")).alias("i"), R.asked_time(F.col("t")).alias("d")).collect()]
    assert [g for g, _, _ in got] == [R.EMPTY] * 2 + [R.CONVERSATIONAL] * 2 + [R.REQUIRED] * 9
    assert [i for _, i, _ in got[4:]] == ["PRESENT", "CHANGE", "HISTORICAL", "CHANGE", "HISTORICAL", "PRESENT", "PRESENT", "PRESENT", "PRESENT"]
    assert [d for _, _, d in got[9:]] == ["2025-02-03", None, None, "2025-02-03"]


@pytest.fixture(scope="module")
def memories(spark):
    row = lambda v, m, user, status, day, content, predicate, label, unit, start=None, end=None, model="m": (v, m, "t", user, "a", status, start, end, D(day), content, predicate, label, model, unit, ["s2", None, " ", "s1"])
    return spark.createDataFrame([
        row("v1", "m1", "u", "CURRENT", 1, "green tea <b>", "likes", "Ann", [1.0, 0.0]), row("v2", "m1", "u", "HISTORICAL", 2, "black tea", "likes", "Ann", [0.8, 0.6]),
        row("v3", "m2", "u", "CONFLICTED", 3, "green tea leaves", "owns", "ann", [0.0, 1.0]), row("v4", "m2", "u", "CONFLICTED", 4, None, None, None, None),
        row("v5", "m3", "u", "INVALIDATED", 5, "green tea", "likes", "Ann", [1.0, 0.0]), row("v6", "m4", "other", "CURRENT", 6, "green tea", "likes", "Ann", [1.0, 0.0]),
        row("v7", "m5", "u", "CURRENT", 7, "green tea", "x", "y", [1.0, 0.0], D(10), D(20), "n"), row("v8", "m2", "u", "CONFLICTED", 8, "green", "owns", None, [0.6, 0.8, 0.0]),
    ], MEMORY)


def asked(spark, text, predicate="likes", label="ANN"):
    return spark.createDataFrame([("q", "t", "u", "a", text, predicate, label, "m", [1.0, 0.0], D(3))], QUERY)


def found(spark, memories, text, **how):
    rows = R.candidates(asked(spark, text, **how), memories, 10).collect()
    return {c: [r.version_id for r in sorted(rows, key=lambda r: r["rank"]) if r.component == c] for c in ("VECTOR", "LEXICAL", "STRUCTURED", "TEMPORAL")}


def test_sources_by_intent_scope_and_status(spark, memories):
    assert found(spark, memories, "Green tea") == {"VECTOR": ["v1", "v3"], "LEXICAL": found(spark, memories, "green tea")["LEXICAL"], "STRUCTURED": ["v1", "v3"], "TEMPORAL": []}
    assert set(found(spark, memories, "green tea")["LEXICAL"]) == {"v1", "v3", "v7"}
    past = found(spark, memories, "used to tea")
    assert past["VECTOR"] == ["v1", "v2", "v3"] and past["STRUCTURED"] == ["v1", "v2", "v3"] and past["TEMPORAL"] == ["v8", "v7", "v4", "v3", "v2", "v1"]
    dated = found(spark, memories, "tea on 2025-01-25")
    assert dated["TEMPORAL"] == ["v8", "v4", "v3", "v1"]  # present statuses, and v7 no longer holds then
    assert found(spark, memories, "hello") == {c: [] for c in past} and found(spark, memories, "x", predicate=None, label=None)["STRUCTURED"] == []


def test_fusion_ties_and_empty_tables(spark, memories):
    hits = spark.createDataFrame([("q", "v1", D(1), "A", 1), ("q", "v3", D(3), "B", 1), ("q", "v2", D(3), "C", 1), ("q", "v1", D(1), "D", 2)], "query_id string, version_id string, recorded_at timestamp_ntz, component string, rank int")
    got = [(r.version_id, r.n_sources) for r in sorted(R.fused(hits, memories, 2).collect(), key=lambda r: r["rank"])]
    assert got == [("v1", 2), ("v2", 1)]
    none = memories.limit(0)
    assert R.candidates(asked(spark, "green tea"), none, 5).count() == 0 and R.candidates(asked(spark, "green tea").limit(0), memories, 5).count() == 0
    assert R.contexts(R.fused(hits.limit(0), memories, 2), 300).count() == 0


def test_context_caps_lineages_and_counts_the_envelope(spark):
    rows = [("q", k + 1, m, v, s, "p", ["b", "a"], c) for k, (m, v, s, c) in enumerate([
        ("m1", "v1", "CURRENT", "one & <two>"), ("m1", "v2", "CURRENT", "again"), ("m2", "v3", "CONFLICTED", "x" * 400), ("m2", "v4", "CONFLICTED", "x"), ("m2", "v5", "CONFLICTED", "y"), ("m2", "v6", "CONFLICTED", "z"), (None, "v7", None, None),
    ])]
    df = spark.createDataFrame(rows, "query_id string, rank int, memory_id string, version_id string, status string, predicate string, sources array<string>, content string")
    r = R.contexts(df, 600).first()
    assert r.chosen == ["v1", "v4", "v5", "v7"] and r.truncated and r.n_ranked == 7 and r.used == len(r.rendered) <= 600
    assert r.rendered.startswith(R.OPEN) and r.rendered.endswith("</memory>\n" + R.CLOSE) and ">one &amp; &lt;two&gt;</memory>" in r.rendered and 'source-event-ids="a,b"' in r.rendered
    assert R.contexts(df, len(R.OPEN) + len(R.CLOSE)).first().chosen == []
    with pytest.raises(ValueError):
        R.contexts(df, 10)


def test_raw_turns_stop_at_the_cutoff(spark, memories):
    got = sorted(R.raw_turns(asked(spark, "any"), memories, 3).collect(), key=lambda r: r["rank"])
    assert [r.version_id for r in got] == ["v1", "v2", "v3"]


def test_permutation(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a", "b"], ["b", "b"]), (["a"], ["a", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(R.same_permutation(F.col("x"), F.col("y"))).collect()] == [True, False, False, True]
