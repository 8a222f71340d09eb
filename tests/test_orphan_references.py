from __future__ import annotations

from datetime import datetime

from mnemoframe.operators.orphan_references import memory_orphans

T = lambda d: datetime(2025, 1, d)


def tables(spark, events=(), candidates=(), lineages=(), versions=(), projections=(), decisions=(), tombstones=()):
    make = lambda data, schema: spark.createDataFrame(list(data), schema + ", ref_key string, bucket int, k int").coalesce(1)  # noqa: E731  with clashing names
    pad = lambda data: [(*r, "?", 0, 0) for r in data]
    return (
        make(pad(events), "source_event_id string, tenant_id string, received_at timestamp_ntz, deletion_state string"),
        make(pad(candidates), "candidate_id string, tenant_id string, created_at timestamp_ntz, content_state string"),
        make(pad(lineages), "memory_id string, tenant_id string, created_at timestamp_ntz"),
        make(pad(versions), "version_id string, tenant_id string, candidate_id string, transaction_time timestamp_ntz"),
        make(pad(projections), "version_id string, tenant_id string, source_event_ids array<string>, projected_at timestamp_ntz"),
        make(pad(decisions), "decision_id string, tenant_id string, candidate_id string, decided_at timestamp_ntz"),
        make(pad(tombstones), "deletion_operation_id string, tenant_id string, object_type string, object_id string, erased_at timestamp_ntz"),
    )


def test_kinds(spark):
    got = memory_orphans(*tables(
        spark,
        events=[("e1", "t", T(5), "ACTIVE"), ("e1", "t", T(3), "ACTIVE"), ("E2 ", "t", T(1), "ERASED"), ("e3", "u", T(1), "ACTIVE")],
        candidates=[("c1", "t", T(9), "AVAILABLE"), ("c2", "t", T(1), "ERASED")],
        lineages=[("m1", "t", T(8))],
        versions=[("v1", "t", " C1\t", T(2)), ("v2", "t", None, T(2)), ("v3", "t", "  ", T(2)), ("v4", "t", "c9", None), ("v5", "t", "c2", T(2))],
        projections=[("v1", "t", ["E1", "e1", None, " ", "e2", "e3"], T(4)), ("v1", "t", ["e1", "e2", "e3"], T(4)), ("v2", "t", None, T(4)), ("v3", "t", [], T(4)), ("v6", "t", ["e1"], T(2)), ("v7", "t", ["e1"], T(3))],
        decisions=[("d1", "t", "c1", T(9)), ("d2", "x", "c1", T(9))],
        tombstones=[("o1", "t", "SOURCE_EVENT", "e2", T(1)), ("o2", "t", "MEMORY_LINEAGE", "M1", T(7)), ("o3", "t", "MEMORY_LINEAGE", "e1", T(7)), ("o4", "t", "OTHER", "zz", T(7))],
    )).collect()
    assert sorted((r.table_name, r.record_id, r.ref_key, r.orphan_kind, r.ref_month or "") for r in got) == sorted([
        ("memory_search_projection", "v1", "e2", "deleted", "2025-01"), ("memory_search_projection", "v1", "e3", "missing", "2025-01"), ("memory_search_projection", "v6", "e1", "late", "2025-01"),
        ("memory_version", "v1", "c1", "late", "2025-01"), ("memory_version", "v4", "c9", "missing", ""), ("memory_version", "v5", "c2", "deleted", "2025-01"),
        ("candidate_policy_decision", "d2", "c1", "missing", "2025-01"), ("erasure_tombstone", "o2", "m1", "late", "2025-01"), ("erasure_tombstone", "o3", "e1", "missing", "2025-01"),
    ])


def test_empty(spark):
    assert memory_orphans(*tables(spark)).count() == 0
