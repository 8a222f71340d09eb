from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mnemoframe.operators.lineage import Fold, Kept, closed_form, fold
from mnemoframe.streaming import pipelines as P


def kept(i, value, s, e, certain=True):
    return Kept(str(i), value, "", s, e, certain, "")


def statuses(f):
    return {k.version_id: k.status for k in f.kept.values()}


def test_create_supersede_backfill():
    f = Fold(True)
    assert f.plan(kept(1, "a", 0, 10))[0] == "CREATE"
    assert f.plan(kept(2, "b", 10, 20)) == ("SUPERSEDE", "2", [("1", "CURRENT", "HISTORICAL")])
    assert f.plan(kept(3, "c", -5, 0))[0] == "SUPERSEDE"
    assert statuses(f) == {"1": "HISTORICAL", "2": "CURRENT", "3": "HISTORICAL"}


def test_conflict_and_uncertain():
    f = Fold(True)
    f.plan(kept(1, "a", 0, 10))
    assert f.plan(kept(2, "b", 5, 15))[0] == "CONFLICT"
    assert statuses(f) == {"1": "CONFLICTED", "2": "CONFLICTED"}
    g = Fold(True)
    g.plan(kept(1, "a", 0, None))
    assert g.plan(kept(2, "b", 5, None))[0] == "CONFLICT"
    h = Fold(True)
    h.plan(kept(1, "a", 0, 10))
    assert h.plan(kept(2, "b", 20, 30, certain=False))[0] == "CONFLICT"


def test_repeat_set_and_invalidation():
    f = Fold(False)
    f.plan(kept(1, "a", 0, 10))
    assert f.plan(kept(2, "a", 50, 60)) == ("REINFORCE", "1", [])
    assert f.plan(kept(3, "b", 0, 10))[0] == "COEXIST"
    assert f.invalidate("1", kept(4, "c", 0, 10)) == [("1", "CURRENT", "INVALIDATED")]
    assert statuses(f) == {"4": "CURRENT", "3": "CURRENT"}
    with pytest.raises(ValueError):
        f.invalidate("1")


def plainly(kept_, new, single):
    """The rules without any index."""
    for v in kept_:
        if v.value == new.value:
            return "REINFORCE", v.version_id, []
    rel = [Fold.relation(new, v) for v in kept_]
    clash = [v for v, r in zip(kept_, rel, strict=True) if r in ("OVERLAPS", "INDETERMINATE")]
    to, status, operation = {}, "CURRENT", "SUPERSEDE"
    if not kept_ or not single:
        operation = "COEXIST" if kept_ else "CREATE"
    elif clash:
        operation, status, to = "CONFLICT", "CONFLICTED", {v.version_id: "CONFLICTED" for v in clash}
    elif "BEFORE" in rel:
        status = "HISTORICAL"
    else:
        to = {v.version_id: "HISTORICAL" for v in kept_}
    changes = sorted((v.version_id, v.status, to[v.version_id]) for v in kept_ if to.get(v.version_id, v.status) != v.status)
    for v in kept_:
        v.status = to.get(v.version_id, v.status)
    new.status = status
    kept_.append(new)
    return operation, new.version_id, changes


bound = st.none() | st.integers(0, 30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), bound, st.integers(1, 8), st.booleans(), st.booleans(), st.sampled_from([True, True, True, False])), max_size=25), st.booleans())
def test_indexed_fold_equals_the_plain_rules(steps, single):
    f, plain, gone = Fold(single), [], 0
    for n, (value, start, length, open_end, drop, certain) in enumerate(steps):
        end = None if open_end and n % 4 == 0 else (start if start is not None else 3) + length
        one, two = (kept(n, str(value), start, end, certain) for _ in range(2))
        assert f.plan(one) == plainly(plain, two, single)
        if drop and n % 5 == 4:
            gone = plain.pop(0)
            assert f.invalidate(gone.version_id) == [(gone.version_id, gone.status, "INVALIDATED")]
    assert statuses(f) == {v.version_id: v.status for v in plain}


def test_a_hot_lineage_is_not_quadratic():
    import time

    f, began = Fold(True), time.perf_counter()
    for n in range(20_000):
        f.plan(kept(n, str(n), n * 10, n * 10 + 9))
    assert time.perf_counter() - began < 5 and sum(v.status == "CURRENT" for v in f.kept.values()) == 1


def test_a_candidate_seen_before_is_ignored():
    f = Fold(True)
    assert f.plan(kept(1, "a", 0, 10), "c1")[0] == "CREATE" and f.plan(kept(2, "b", 20, 30), "c1") == ("IGNORE", None, []) and list(f.kept) == ["1"]


cases = st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(1, 9)), min_size=1, max_size=8), min_size=1, max_size=12)


@settings(max_examples=4, deadline=None)
@given(cases)
def test_fold_equals_closed_form(spark, lineages):
    rows, want = [], {}
    for k, steps in enumerate(lineages):
        f, at = Fold(True), 0
        for n, (value, gap, length) in enumerate(steps):
            at += gap + (1 if n else 0)  # starts ascend strictly
            rows.append((f"l{k}", n, at, at + length, str(value)))
            f.plan(kept(n, str(value), at, at + length))
        want |= {(f"l{k}", int(i)): s for i, s in statuses(f).items()}
    got = closed_form(spark.createDataFrame(rows, "lineage string, n long, s long, e long, value string"))
    assert {(r.lineage, r.n): r.status for r in got.collect()} == want


def version_rows():
    base = datetime(2025, 1, 1)
    out = []
    for k in range(40):
        m = f"m{k % 5}"
        out.append((m, k // 5 + 1, f"v{k:02d}", f'"{k * 7 % 11}"', "Text", base + timedelta(days=k // 5), None if k % 3 else base + timedelta(days=k // 5 + 1), "DAY", 0.9))
    return out + out[:3]  # copies


def test_stream_fold_equals_batch(spark, tmp_path):
    v = spark.createDataFrame(version_rows(), "memory_id string, version_number long, version_id string, value_json string, normalized_content string, valid_time_start timestamp_ntz, valid_time_end timestamp_ntz, valid_time_precision string, confidence double")
    kinds = spark.createDataFrame([(f"m{k}", "SINGLE" if k % 2 else "SET") for k in range(5)], "memory_id string, predicate_cardinality string")
    batch = {(r.version_id, r.operation, r.new_status) for r in fold(v, kinds).collect()}
    assert len(batch) == 40
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ready = v.join(kinds, "memory_id").select(
        "memory_id", "version_number", "version_id", (F.col("predicate_cardinality") == "SINGLE").alias("single"), "value_json", F.col("normalized_content").alias("content"),
        micros("valid_time_start").alias("s"), micros("valid_time_end").alias("e"), F.lit(True).alias("k"),
    )
    for part in (0, 1):  # two micro-batches: state has to carry over
        ready.where((F.col("version_number") > 4) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ready.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = P.drain(P.folded(stream))
    assert {(r.version_id, r.operation, r.new_status) for r in got.collect()} == batch


def test_stream_ingest_is_idempotent(spark, tmp_path):
    put = P.ingest_batch(str(tmp_path / "table"))
    schema = "tenant_id string, idempotency_key string, received_at timestamp, trace_id string"
    t = datetime(2025, 1, 1)
    one = spark.createDataFrame([("t", "a", t, "1"), ("t", "a", t, "2"), ("t", "b", t, "3")], schema)
    two = spark.createDataFrame([("t", "b", t, "4"), ("t", "c", t, "5"), ("u", "c", t, "6")], schema)
    put(one, 0)
    put(two, 1)
    put(two, 1)  # a repeated batch
    assert {(r.tenant_id, r.idempotency_key, r.trace_id) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {("t", "a", "1"), ("t", "b", "3"), ("t", "c", "5"), ("u", "c", "6")}


def test_chain_of_stages_survives_a_repeated_batch(spark, tmp_path):
    t = datetime(2025, 1, 1)
    schema = "source_event_id string, tenant_id string, idempotency_key string, received_at timestamp, trace_id string"
    candidates = spark.createDataFrame([("c1", "e1"), ("c2", "e2"), ("c3", "e9"), (None, "e1")], "candidate_id string, source_event_id string")
    versions = spark.createDataFrame([("v1", "c1"), ("v2", "c2"), ("v3", "c3"), ("v4", None)], "version_id string, candidate_id string")
    put = P.chained(str(tmp_path), candidates, versions)
    one = spark.createDataFrame([("e1", "t", "a", t, "1")], schema)
    two = spark.createDataFrame([("e1", "t", "a", t, "2"), ("e2", "t", "b", t, "3")], schema)
    for batch, k in ((one, 0), (two, 1), (two, 1), (two.limit(0), 2)):
        put(batch, k)
    rows = spark.read.parquet(str(tmp_path / "projection")).collect()
    assert sorted((r.batch, r.version_id, r.source_event_ids) for r in rows) == [(0, "v1", ["e1"]), (1, "v2", ["e2"])]
