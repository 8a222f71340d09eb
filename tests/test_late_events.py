from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import given, settings, strategies as st

from mnemoframe.operators.finger_tree import FingerTree
from mnemoframe.operators.late_events import daily_counts, hourly_counts, late_events

SCHEMA = "source_event_id string, occurred_at timestamp_ntz, received_at timestamp_ntz, hour long, slab string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60), st.integers(0, 3)), max_size=300))
def test_tree_equals_dictionary(steps):
    tree, want, floor = FingerTree(width=4), {}, None
    for evict, key, n in steps:
        if evict and n == 0:
            gone = tree.evict(key // 2)
            if floor is None or key // 2 > floor:
                floor = key // 2
            assert gone == [(k, *want.pop(k)) for k in sorted(want) if k <= floor]
        else:
            assert tree.add(key, n, 1) == (floor is None or key > floor)
            if floor is None or key > floor:
                old = want.get(key, [0, 0])
                want[key] = [old[0] + n, old[1] + 1]
        assert tree.entries() == [(k, *want[k]) for k in sorted(want)]
        assert tree.total() == (sum(v[0] for v in want.values()), sum(v[1] for v in want.values()))
        assert tree.range_sum(10, 40) == tuple(sum(v[i] for k, v in want.items() if 10 <= k <= 40) for i in (0, 1))


def rows(*events):
    base = datetime(2025, 3, 1, 10, 30)
    return [(i, None if o is None else base + timedelta(minutes=o), None if r is None else base + timedelta(minutes=r), 7, "x") for i, o, r in events]


def test_bounds_copies_and_nulls(spark):
    close = 30  # minutes from the event to its hour's end
    data = rows(
        ("exact-grace", 0, close + 15), ("just-late", 0, close + 15.0001), ("exact-cut", 0, close + 48 * 60), ("dropped", 0, close + 48 * 60 + 0.0001),
        ("copy", 0, 5000), ("copy", 0, 20), ("early", 0, -50), ("no-time", None, 10), ("no-arrival", 0, None), (None, 0, 5000), ("far", -60 * 24 * 400, 60 * 24 * 400),
    )
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r[0], r[2]) for r in late_events(df).collect()}
    assert got == {("just-late", "corrected"), ("exact-cut", "corrected"), ("dropped", "dropped"), ("far", "dropped")}
    hours = {r["event_hour"]: r for r in hourly_counts(df).collect()}
    h = hours["2025-03-01 10:00"]
    assert (h["n_first"], h["n_corrected"], h["n_final"], h["n_dropped"]) == (3, 2, 5, 1)
    # however rows are spread over tasks, nothing changes
    assert {(r[0], r[2]) for r in late_events(df, rows_per_task=1, slab_hours=1).collect()} == got
    assert sorted(map(tuple, hourly_counts(df, rows_per_task=1).collect())) == sorted(map(tuple, hours.values()))


def test_days_are_the_sums_of_their_hours(spark):
    import random

    rng = random.Random(3)
    data = rows(*((f"e{k}", (at := rng.randint(0, 60 * 24 * 20)), at + rng.choice((5, 60, 600, 3000, 9000))) for k in range(1500)))
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for r in hourly_counts(df).collect():
        day = want.setdefault(r.event_hour[:10], [0, 0, 0, 0])
        for k, c in enumerate(("n_first", "n_corrected", "n_final", "n_dropped")):
            day[k] += r[c]
    for per_task in (250_000, 100):
        assert {r.event_day: [r.n_first, r.n_corrected, r.n_final, r.n_dropped] for r in daily_counts(df, rows_per_task=per_task).collect()} == want
    assert sum(d[3] for d in want.values()) > 50 and daily_counts(df.limit(0)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert late_events(df).count() == 0 and hourly_counts(df).count() == 0
