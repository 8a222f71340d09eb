"""Neighbours of vectors with many copies but few ids, and of those in small cells."""

from __future__ import annotations

import numpy as np

from test_vectors import brute, clustered, found


def test_copies_of_few_ids_keep_their_other_neighbours(spark):
    x = clustered(120, 8, 3, 5)
    rows = [(f"v{k:03d}", "m", 8, v.tolist()) for k, v in enumerate(x)]
    rows += [("a", "m", 8, x[7].round(1).tolist())] * 60 + [(i, "m", 8, x[40].round(1).tolist()) for i in ("b", "w", "x")] * 20
    assert found(spark, rows) == brute(rows)


def test_small_cells_look_into_others(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([[9, 0, 0, 0] + rng.normal(size=(60, 4)), [0, 9, 0, 0] + rng.normal(size=(60, 4)), [0, 0, 0, 9] + 0.01 * rng.normal(size=(3, 4))])
    rows = [(f"v{k:03d}", "m", 4, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    want, got = brute(rows), found(spark, rows, target=41)
    ends = {f"v{k}" for k in (120, 121, 122)}
    assert all(sum(i in p for p in got) >= 5 for i in ends)
    assert len(got & want) / len(want) >= 0.95
