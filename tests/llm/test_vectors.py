from __future__ import annotations

import numpy as np
import pytest

from mnemoframe.llm import vectors as V

SCHEMA = "version_id string, embedding_model_version string, embedding_dimensions int, embedding array<float>, id string, model string, shard int"


def brute(rows, k=5):
    usable = {}
    for i, m, d, e in rows:
        if None in (i, m, d, e) or len(e) != d or any(x is None for x in e):
            continue
        x = np.array(e, np.float32).astype(float)
        if np.isfinite(x).all() and x.any():
            usable[m, d, i] = x / np.linalg.norm(x)
    out = set()
    for m, d in {key[:2] for key in usable}:
        ids = sorted(i for a, b, i in usable if (a, b) == (m, d))
        x = np.array([usable[m, d, i] for i in ids])
        s = np.round(x @ x.T, 12)
        for a in range(len(ids)):
            for b in [j for j in np.argsort(-s[a], kind="stable")[: k + 1].tolist() if j != a][:k]:  # ids ascend
                out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], SCHEMA)


def found(spark, rows, **how):
    got = [tuple(r) for r in V.nearest_pairs(frame(spark, rows), **how).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def clustered(n, d, groups, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, d))
    return (c[rng.integers(groups, size=n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float32)


def test_recall(spark):
    x = clustered(6000, 24, 40)
    rows = [(f"v{k:05d}", "m" if k % 3 else "n", 24, v.tolist()) for k, v in enumerate(x)]
    want, got = brute(rows), found(spark, rows, target=500)
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_large_cells_are_cut_again(spark):
    x = clustered(1800, 16, 60, 4)
    same = [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0] * 2
    rows = [(f"v{k:05d}", "a/b", 16, v.tolist()) for k, v in enumerate(x)] + [(f"s{k:03d}", "a/b", 16, same) for k in range(250)]
    how = dict(sample=600, target=50, most_cells=3, heavy_share=0.5)
    picked = frame(spark, rows).selectExpr("version_id AS id", "embedding_model_version AS model", "embedding_dimensions AS d", "embedding")
    plans = V.shards(picked, 5, margin=0.1, per_shard=32, most_shards=1000, **how)
    sizes = picked.mapInArrow(V._placed(plans, 0.1), "model string, shard int, id string").where("shard >= 0").groupBy("shard").count().collect()
    assert len(sizes) > 20 and max(r[1] for r in sizes) <= 4 * 50  # the 250 equal ones stand apart
    want, got = brute(rows), found(spark, rows, **how)
    light = {p for p in want if not p[0][0] == p[1][0] == "s"}
    assert len(got & want) / len(want) >= 0.93 and len(got & light) / len(light) >= 0.9
    with pytest.raises(ValueError, match="shards, more than 3"):
        V.shards(picked, 5, margin=0.1, per_shard=32, most_shards=3, **how)


def test_small_and_dirty_rows_are_exact(spark):
    x = clustered(60, 8, 4, 1)
    rows = [(f"v{k:03d}", "m", 8, v.tolist()) for k, v in enumerate(x)]
    rows += rows[:7]  # copies
    rows += [("nul", "m", 8, None), ("short", "m", 8, [1.0] * 7), ("zero", "m", 8, [0.0] * 8), ("nan", "m", 8, [float("nan")] + [1.0] * 7), ("inf", "m", 8, [float("inf")] + [1.0] * 7), ("hole", "m", 8, [None] + [1.0] * 7)]
    rows += [(None, "m", 8, [1.0] * 8), ("nomodel", None, 8, [1.0] * 8), ("nodim", "m", None, [1.0] * 8), ("alone", "solo", 8, [1.0] * 8), ("p1", "pair", 2, [1.0, 0.0]), ("p2", "pair", 2, [0.0, 3.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()


def test_many_equal_vectors_take_the_least_ids(spark):
    x = clustered(300, 8, 6, 2)
    same = [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(f"v{k:03d}", "m", 8, v.tolist()) for k, v in enumerate(x)] + [(f"s{k:03d}", "m", 8, same) for k in range(150)] * 2
    want, got = brute(rows), found(spark, rows)
    heavy = {p for p in want if p[0][0] == p[1][0] == "s"}
    assert heavy <= got and len({p for p in got if p[0][0] == p[1][0] == "s"}) == len(heavy)
    assert len(got & want) / len(want) >= 0.97


def test_graph_keeps_diverse_edges():
    x = clustered(800, 16, 8, 3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = V.build(x)
    assert g.shape == (801, 16) and (g[:-1] >= 0).any(axis=1).all() and (g[-1] == -1).all()
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in g)
    ids, dist = V.neighbours(x, 5)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) for a, b in zip(best.tolist(), ids.tolist(), strict=True)]) / 5 > 0.97
    assert (np.diff(dist, axis=1) >= 0).all()
