"""The as-of join where changes are not recorded in order of time."""

from __future__ import annotations

import random

from mnemoframe.operators.history import as_of_many


def test_equals_the_latest_change_up_to_the_probe(spark):
    rng = random.Random(2)
    rows = [("t", f"m{k % 3}", f"v{k % 11}", seq, rng.randint(0, 1), rng.choice("ABCD"), rng.randint(0, 9)) for k in range(11) for seq in range(rng.randint(1, 4))]
    rows = list({r[:5]: r for r in rows}.values())
    probes = [(f"p{k}", f"m{k % 4}", k % 11) for k in range(40)]
    want = set()
    for p, m, t in probes:
        for v in {r[2] for r in rows if r[1] == m}:
            seen = [r for r in rows if r[1] == m and r[2] == v and r[6] <= t]
            if seen:
                want.add((p, m, v, max(seen, key=lambda r: (r[3], r[4]))[5]))
    log = spark.createDataFrame(rows, "tenant_id string, memory_id string, version_id string, sequence int, ordinal int, to_status string, occurred_at int")
    got = as_of_many(log, spark.createDataFrame(probes, "probe_id string, memory_id string, probe_time int")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert as_of_many(log.limit(0), spark.createDataFrame(probes, "probe_id string, memory_id string, probe_time int")).count() == 0
