"""The closed form over all event types against a plain walk through each lineage."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np

from mnemoframe.plans import history as Q

HALF_DAY = timedelta(hours=12)


def walk(events):
    lineages = defaultdict(list)
    for n, ts, user, kind, value in sorted(events):
        if value not in (v for _, _, v in lineages[f"{user}/{kind}"]):
            lineages[f"{user}/{kind}"].append((n, ts, value))
    out = set()
    for lineage, rows in lineages.items():
        overlaps = lambda a, b: a[0] != b[0] and a[1] < b[1] + HALF_DAY and b[1] < a[1] + HALF_DAY
        last = max(r[0] for r in rows if not any(overlaps(r, x) for x in rows if x[0] < r[0]))
        for r in rows:
            later = any(overlaps(r, x) for x in rows if x[0] > last)
            out.add((lineage, r[0], r[2], "CONFLICTED" if r[0] > last or later else "CURRENT" if r[0] == last else "HISTORICAL"))
    return out


def test_all_event_types(spark, tmp_path):
    rng = np.random.default_rng(4)
    at, events = datetime(2025, 1, 1), []
    for n in range(400):
        at += timedelta(minutes=int(rng.integers(0, 200)))
        events.append((n, at, int(rng.integers(4)), ("view", "click", "purchase")[rng.integers(3)], float(rng.integers(30))))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in Q.closed_form_status(spark, str(tmp_path)).select("lineage", "n", "value", "status").collect()}
    assert got == walk(events) and {r[0].split("/")[1] for r in got} == {"view", "click", "purchase"}
    assert {r[3] for r in got} == {"CONFLICTED", "CURRENT", "HISTORICAL"}
