"""Nearest vectors of every vector (problem 5) by robust-pruned directed graphs in shards.

Cells of a k-means over a bounded sample make shards, cells that are still too large are cut again by a sample of their own; a vector
near the border of two cells stands in both. Each shard's graph is
built by greedy searches that propose neighbours and by relaxed distance pruning that keeps diverse edges; beam
search, started at each vector's own edges, gives its neighbours. Shards' results are merged by double-precision similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F


def _order(d: np.ndarray, keep: int) -> np.ndarray:
    return np.argsort(d, axis=1, kind="stable")[:, :keep]


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, expand: int = 4, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once; ids (-1 where there are fewer) and squared distances, ascending.

    ``entries``: (queries, m) start nodes, -1 for none, without repeats in a row. ``seen``: one node per query not to be visited.
    """
    count, n = len(queries), len(x)
    ids = np.full((count, width), -1, np.int32)
    dist = np.full((count, width), np.inf, np.float32)
    done = np.ones((count, width), bool)
    visited = np.zeros((count, n + 1), bool)
    visited[:, n] = True  # column of the absent node -1
    if seen is not None:
        visited[np.arange(count), seen] = True
    active = np.arange(count)
    new = entries
    while len(active):
        k = new.shape[1]
        rows = np.repeat(np.arange(len(active)), k)
        flat = new.ravel()
        fresh = np.flatnonzero(~visited[active[rows], flat])
        rows, flat = rows[fresh], flat[fresh]
        # a node may be proposed twice in one step: the first stays
        key = rows.astype(np.int64) * n + flat
        _, first = np.unique(key, return_index=True)
        rows, flat, fresh = rows[first], flat[first], fresh[first]
        visited[active[rows], flat] = True
        d = np.full(len(active) * k, np.inf, np.float32)
        d[fresh] = 2 - 2 * np.einsum("vd,vd->v", x[flat], queries[active[rows]])
        all_d = np.concatenate([dist[active], d.reshape(-1, k)], axis=1)
        best = _order(all_d, width)
        take = np.arange(len(active))[:, None]
        ids[active] = np.concatenate([ids[active], new], axis=1)[take, best]
        dist[active] = all_d[take, best]
        done[active] = np.concatenate([done[active], np.zeros((len(active), k), bool)], axis=1)[take, best] | np.isinf(dist[active])
        active = active[~done[active].all(axis=1)]
        if not len(active):
            break
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :expand]
        take = np.arange(len(active))[:, None]
        nodes = np.where(done[active][take, pick], -1, ids[active][take, pick])
        flags = done[active]
        flags[take, pick] = True
        done[active] = flags
        new = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(active), -1)
    ids[np.isinf(dist)] = -1
    return ids, dist


def prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of ``own``, up to ``degree`` of its candidates (ascending by distance, -1 for none), none much nearer to a kept one."""
    count, k = ids.shape
    vectors = x[ids]
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = ids >= 0
    alive &= ids != own[:, None]
    out = np.full((count, degree), -1, np.int32)
    rows = np.arange(count)
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, slot] = ids[rows[some], first[some]]
        alive &= ~(alpha * between[rows, first] <= dist)
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = 16, width: int = 24, alpha: float = 1.2, seed: int = 0) -> np.ndarray:
    """The out-edges (n, degree) of a graph over unit vectors; nodes are inserted in random order, in growing batches."""
    n = len(x)
    graph = np.full((n + 1, degree), -1, np.int32)  # the last row belongs to the absent node -1
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    at = min(n, 3 * degree)
    base = order[:at]
    d = 2 - 2 * x[base] @ x[base].T
    near = np.argsort(d, axis=1)
    graph[base] = prune(x, base, base[near], np.take_along_axis(d, near, 1), degree, alpha)
    doors = 2 * degree  # searches start at so many nodes spread over the shard, so that far groups are reached
    while at < n:
        batch = order[at : min(n, at + max(degree, at // 2), at + 2048)]
        entries = np.broadcast_to(order[:at][:: max(1, at // doors)][:doors], (len(batch), min(at, doors)))
        ids, dist = search(x, graph, x[batch], entries, width)
        # nodes of one batch do not see each other in the search: their nearest join the candidates
        if len(batch) > 1:
            mutual = 2 - 2 * x[batch] @ x[batch].T
            np.fill_diagonal(mutual, np.inf)
            m = min(8, len(batch) - 1)
            close = np.argpartition(mutual, m - 1, axis=1)[:, :m]
            ids = np.concatenate([ids, batch[close]], axis=1)
            dist = np.concatenate([dist, np.take_along_axis(mutual, close, 1)], axis=1)
            best = _order(dist, ids.shape[1])
            ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
        graph[batch] = prune(x, batch, ids, dist, degree, alpha)
        _reverse(x, graph, batch, degree, alpha)
        at += len(batch)
    return graph


def _reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges back from the batch's new neighbours; a full node is pruned again over old and new edges."""
    to = graph[batch].ravel()
    source = np.repeat(batch, degree)
    ok = (to >= 0) & (graph[to] != source[:, None]).all(axis=1)
    to, source = to[ok], source[ok]
    by = np.argsort(to, kind="stable")
    to, source = to[by], source[by]
    nodes, begin, counts = np.unique(to, return_index=True, return_counts=True)
    free = degree - (graph[nodes] >= 0).sum(axis=1)
    rank = np.arange(len(to)) - np.repeat(begin, counts)
    fits = np.repeat(counts <= free, counts)
    graph[to[fits], (np.repeat(degree - free, counts) + rank)[fits]] = source[fits]
    full = np.flatnonzero(counts > free)
    if not len(full):
        return
    most = 2 * degree  # the nearest new edges are enough for a choice of ``degree``
    width = degree + min(most, int(counts[full].max()))
    ids = np.full((len(full), width), -1, np.int32)
    ids[:, :degree] = graph[nodes[full]]
    for row, k in enumerate(full):
        some = source[begin[k] : begin[k] + counts[k]]
        if len(some) > most:
            some = some[np.argpartition(-(x[some] @ x[nodes[k]]), most - 1)[:most]]
        ids[row, degree : degree + len(some)] = some
    own = nodes[full]
    dist = 2 - 2 * np.einsum("nkd,nd->nk", x[ids], x[own])
    dist[ids < 0] = np.inf
    best = _order(dist, width)
    graph[own] = prune(x, own, np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1), degree, alpha)


def neighbours(x: np.ndarray, k: int, degree: int = 16, width: int = 24, alpha: float = 1.2, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """About the k + 3 nearest others of each unit vector, by a graph over them; -1 where there are fewer."""
    n = len(x)
    graph = build(x, degree, width, alpha)
    out, far = [], []
    for at in range(0, n, block):
        own = np.arange(at, min(n, at + block), dtype=np.int32)
        ids, dist = search(x, graph, x[own], graph[own], width, seen=own)
        out.append(ids[:, : k + 3])
        far.append(dist[:, : k + 3])
    return np.concatenate(out), np.concatenate(far)


def cells(x: np.ndarray, rows: float, target: int, most: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Unit centroids from a sample of unit vectors standing for ``rows`` rows, so that cells hold about ``target`` of them."""
    n = len(x)
    k = int(min(most, max(1, round(rows / target)), max(1, n // 4)))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(n, k, replace=False)].copy()

    def own(c: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[at : at + 4096] @ c.T).argmax(axis=1) for at in range(0, n, 4096)])

    for turn in range(rounds):
        a = own(c)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        size = np.bincount(a, minlength=len(c))
        for j in np.flatnonzero(size == 0):
            sums[j] = x[rng.integers(n)]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if turn < rounds - 3:  # a cell much too large gets a second centroid
            large = np.flatnonzero(size * (rows / n) > 2 * target)[: max(0, most - len(c))]
            if len(large):
                c = np.concatenate([c, x[[rng.choice(np.flatnonzero(a == j)) for j in large]]])
    return c.astype(np.float32)


class Plan(NamedTuple):
    """What the samples give of one model: centroids, those within cells that were cut again, and the raw bytes of vectors that many rows share."""

    centroids: np.ndarray
    heavy: tuple[bytes, ...] = ()
    within: dict[int, np.ndarray] = {}  # noqa: RUF012  (never changed)
    first: dict[int, int] = {}  # noqa: RUF012  the number of the first shard of a cell that was cut

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest shard of each unit vector, the next one, and the similarities of both."""
        near = unit @ self.centroids.T
        at = np.arange(len(near))
        top = np.full((2, len(near)), -1, np.int64)
        sims = np.full((2, len(near)), -9.0, np.float32)
        for k in range(min(2, near.shape[1])):
            top[k] = near.argmax(axis=1)
            sims[k] = near[at, top[k]]
            near[at, top[k]] = -9
        if not self.within:
            return top[0], np.maximum(top[1], 0), sims[0], sims[1]
        shards, best = np.full((3, len(near)), -1, np.int64), np.full((3, len(near)), -9.0, np.float32)
        for k in range(2):  # of the nearest cell its two nearest shards, of the next cell its nearest
            for cell in np.unique(top[k][top[k] >= 0]).tolist():
                mine = np.flatnonzero(top[k] == cell)
                if cell not in self.within:
                    shards[2 * k, mine], best[2 * k, mine] = cell, sims[k, mine]
                    continue
                inner = unit[mine] @ self.within[cell].T
                row = np.arange(len(mine))
                one = inner.argmax(axis=1)
                shards[2 * k, mine], best[2 * k, mine] = self.first[cell] + one, inner[row, one]
                if k == 0 and inner.shape[1] > 1:
                    inner[row, one] = -9
                    two = inner.argmax(axis=1)
                    shards[1, mine], best[1, mine] = self.first[cell] + two, inner[row, two]
        order = np.argsort(-best, axis=0, kind="stable")[:2]
        shards, best = np.take_along_axis(shards, order, 0), np.take_along_axis(best, order, 0)
        return shards[0], shards[1], best[0], best[1]


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Per model: ids, raw vectors and unit vectors of usable rows; columns are id, model, dimensions, embedding."""
    lengths = batch.column(3).value_lengths()
    ok = pc.and_(pc.equal(lengths, batch.column(2)), pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
    batch = batch.filter(pc.fill_null(ok, False))
    for model in pc.unique(batch.column(1)).to_pylist():
        mine = batch.filter(pc.equal(batch.column(1), model))
        for d in pc.unique(mine.column(2)).to_pylist():
            part = mine.filter(pc.equal(mine.column(2), d))
            if not d or d < 1:
                continue
            raw = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, d)
            with np.errstate(all="ignore"):
                norm = np.sqrt((raw.astype(np.float64) ** 2).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
            raw, norm = raw[good], norm[good]
            if len(raw):
                yield model, part.column(0).filter(pa.array(good)), raw, (raw / norm[:, None]).astype(np.float32)


def _binary(raw: np.ndarray) -> pa.Array:
    n, width = raw.shape[0], raw.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(raw))])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"".join(chunk.to_pylist()), np.float32) for chunk in column.chunks]).reshape(len(column), -1)


def _learn(rows_per_sample: float, target: int, most: int, share: float) -> Callable[[pa.Table], pa.Table]:
    """Centroids and shared vectors of a sample: of a model's (cell -1), or of a cell's that is cut again, where a vector of more than ``target`` rows counts."""

    def run(rows: pa.Table) -> pa.Table:
        cell = rows["cell"][0].as_py()
        by_length: dict[int, list[bytes]] = {}
        for v in rows["vec"].to_pylist():
            by_length.setdefault(len(v), []).append(v)
        out = []
        for length, vectors in sorted(by_length.items()):
            counts: dict[bytes, int] = {}
            for v in vectors:
                counts[v] = counts.get(v, 0) + 1
            enough = max(20, share * len(vectors)) if cell < 0 else max(8, target / rows_per_sample)
            heavy = [v for v, c in counts.items() if c >= enough]
            light = [v for v in vectors if counts[v] < enough] or heavy
            x = np.frombuffer(b"".join(light), np.float32).reshape(len(light), length // 4).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            out.append((rows["model"][0].as_py(), cell, length // 4, cells(x, len(light) * rows_per_sample, target, most).tobytes(), heavy))
        cols = list(zip(*out, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["model", "cell", "d", "centroids", "heavy"])

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for model, _, raw, _ in _usable(batch):
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(raw), pa.string()), pa.array([-1] * len(raw), pa.int32()), _binary(raw)], names=["model", "cell", "vec"])


def _assign(plans: dict[tuple[str, int], Plan], margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["model", "shard", "id", "twin", "vec"]

    def rows(model: str, d: int, shard: np.ndarray, ids: pa.Array, twin: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{model}/{d}"] * len(ids), pa.string()), pa.array(shard, pa.int32()), ids.cast(pa.string()), pa.array(twin), _binary(raw)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, ids, raw, unit in _usable(batch):
                d = raw.shape[1]
                plan = plans.get((model, d)) or Plan(np.zeros((1, d), np.float32), ())
                if plan.heavy:
                    place = {v: j for j, v in enumerate(plan.heavy)}
                    which = np.array([place.get(r.tobytes(), -1) for r in raw])
                    shared = which >= 0
                    if shared.any():
                        own = ids.filter(pa.array(shared))
                        yield rows(model, d, -1 - which[shared], own, np.zeros(int(shared.sum()), bool), raw[shared][:, :0])
                        keep = ~shared
                        ids, raw, unit = ids.filter(pa.array(keep)), raw[keep], unit[keep]
                        if not len(raw):
                            continue
                first, second, best, next_best = plan.place(unit)
                twin = next_best >= best - margin
                yield rows(model, d, first, ids, twin, raw)
                if twin.any():
                    yield rows(model, d, second[twin], ids.filter(pa.array(twin)), np.ones(int(twin.sum()), bool), raw[twin])

    return run


def _placed(plans: dict[tuple[str, int], Plan], margin: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which cells ids fall in, without their vectors."""
    return lambda batches: (b.select(["model", "shard", "id"]) for b in _assign(plans, margin)(batches))


def _filled(plan: Plan, sizes: dict[int, int], least: int) -> Plan:
    """The plan without shards of fewer than ``least`` ids; their rows go to the next one, so others only grow. The largest stays."""
    within, cut = {}, {}
    for cell, c in plan.within.items():
        keep = [j for j in range(len(c)) if sizes.get(plan.first[cell] + j, 0) >= least]
        if keep:
            within[cell], cut[cell] = c[keep], sum(sizes.get(plan.first[cell] + j, 0) for j in keep)
    size = lambda j: cut.get(j, 0) or sizes.get(j, 0)
    keep = [j for j in range(len(plan.centroids)) if size(j) >= least] or [max(range(len(plan.centroids)), key=size)]
    return _numbered(plan.centroids[keep], plan.heavy, {k: within[j] for k, j in enumerate(keep) if j in within})


def _numbered(centroids: np.ndarray, heavy: tuple[bytes, ...], within: dict[int, np.ndarray]) -> Plan:
    """Shards of cells that were cut again are numbered behind the cells."""
    first, at = {}, len(centroids)
    for cell in sorted(within):
        first[cell] = at
        at += len(within[cell])
    return Plan(centroids, heavy, within, first)


def _hashed(share: float) -> F.Column:
    """About this share of the ids, the same ones on every run."""
    return F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 50)) < F.lit(max(1, int(share * (1 << 50))))


def _pairs(k: int, degree: int, width: int, alpha: float) -> Callable[[pa.Table], pa.Table]:
    """Edges of one shard: settled ones as pairs a < b with null similarity, those of vectors with a twin elsewhere with theirs."""

    def run(rows: pa.Table) -> pa.Table:
        ids, at = np.unique(np.array(rows["id"].to_pylist(), dtype=object).astype(str), return_index=True)
        raw = _matrix(rows["vec"])[at].astype(np.float64)
        twin = rows["twin"].to_numpy()[at]
        exact = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        n = len(ids)
        empty = pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if n < 2:
            return empty
        # equal vectors are one node of the graph, of which at most the k + 1 least ids can be among anyone's nearest
        _, head, own = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        near, _ = neighbours(exact[head].astype(np.float32), k, degree, width, alpha)
        if len(head) == n:
            found = np.empty_like(near)
            found[head] = np.where(near >= 0, head[near], -1)
        else:
            by = np.argsort(own, kind="stable")
            place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(np.bincount(own))[:-1]]), np.bincount(own))
            least = np.full((len(head) + 1, k + 1), -1)
            first = place <= k
            least[own[by][first], place[first]] = by[first]
            found = np.concatenate([least[own], least[near[own]].reshape(n, -1)], axis=1)
            found[found == np.arange(n)[:, None]] = -1
        sim = np.einsum("nkd,nd->nk", exact[found], exact)
        if len(head) < n:
            sim[:, : k + 1] = 1.0
            sim = np.where(sim > 1 - 1e-15, 1.0, sim)
        sim[found < 0] = -np.inf
        rank = np.lexsort((found, -sim), axis=1)[:, :k]  # ids ascend, so a tie goes to the smaller one
        found, sim = np.take_along_axis(found, rank, 1), np.take_along_axis(sim, rank, 1)
        a, b, s = np.repeat(np.arange(n), found.shape[1]), found.ravel(), sim.ravel()
        ok = b >= 0
        a, b, s = a[ok], b[ok], s[ok]
        open_ = twin[a]
        done = np.unique(np.minimum(a, b)[~open_].astype(np.int64) * n + np.maximum(a, b)[~open_])
        one, two = np.concatenate([done // n, a[open_]]), np.concatenate([done % n, b[open_]])
        return pa.table({"a": pa.array(ids[one], pa.string()), "b": pa.array(ids[two], pa.string()), "similarity": pa.array(np.concatenate([np.zeros(len(done)), s[open_]]), mask=np.concatenate([np.ones(len(done), bool), np.zeros(int(open_.sum()), bool)]))})

    return run


def shards(picked: DataFrame, k: int, sample: int, target: int, most_cells: int, margin: float, heavy_share: float, per_shard: int, most_shards: int) -> dict[tuple[str, int], Plan]:
    """The plan of each model and length: cells by a bounded sample, those that hold too many ids cut again, those that hold too few dissolved."""
    total = max(1, picked.count())
    share = min(1.0, sample / total)
    some = picked if share >= 1 else picked.where(_hashed(share))
    plan_schema = "model string, cell int, d int, centroids binary, heavy array<binary>"
    learned = some.mapInArrow(_sampled, "model string, cell int, vec binary").groupBy("model").applyInArrow(_learn(1 / share, target, most_cells, heavy_share), plan_schema).collect()
    matrix = lambda r: np.frombuffer(bytes(r["centroids"]), np.float32).reshape(-1, r["d"])
    plans = {(r["model"], r["d"]): Plan(matrix(r), tuple(bytes(v) for v in r["heavy"])) for r in learned}

    def counted() -> dict[str, dict[int, int]]:
        sizes: dict[str, dict[int, int]] = {}
        for r in picked.mapInArrow(_placed(plans, margin), "model string, shard int, id string").where("shard >= 0").groupBy("model", "shard").agg(F.countDistinct("id").alias("n")).collect():
            sizes.setdefault(r["model"], {})[r["shard"]] = r["n"]
        return sizes

    sizes = counted()
    large = [(m, j, n) for m, by in sizes.items() for j, n in by.items() if n > 4 * target]
    if large:
        if (wanted := sum(n for *_, n in large) // target) > most_shards:
            raise ValueError(f"about {wanted} shards, more than {most_shards}: raise target or most_shards")
        # a cell that is too large is cut by a sample of its own; all samples together hold a few rows a shard
        few = min(1.0, per_shard / target)
        cells_ = picked.sparkSession.createDataFrame([(m, j) for m, j, _ in large], "model string, shard int")
        rows_of = (picked if few >= 1 else picked.where(_hashed(few))).mapInArrow(_assign(plans, margin), "model string, shard int, id string, twin boolean, vec binary").join(F.broadcast(cells_), ["model", "shard"])
        inner = rows_of.select(F.expr("substring_index(model, '/', length(model) - length(replace(model, '/', '')))").alias("model"), F.col("shard").alias("cell"), "vec")
        again = inner.groupBy("model", "cell").applyInArrow(_learn(1 / few, target, most_shards, heavy_share), plan_schema).collect()
        for key, plan in plans.items():
            mine = [r for r in again if (r["model"], r["d"]) == key]
            heavy_too = tuple(dict.fromkeys([*plan.heavy, *(bytes(v) for r in mine for v in r["heavy"])]))
            plans[key] = _numbered(plan.centroids, heavy_too, {r["cell"]: matrix(r) for r in mine})
        sizes = counted()
    plans = {(m, d): _filled(p, sizes.get(f"{m}/{d}", {}), k + 1) for (m, d), p in plans.items()}
    return plans


def nearest_pairs(rows: DataFrame, id_column: str = "version_id", k: int = 5, sample: int = 60_000, target: int = 2_000, most_cells: int = 4_096, margin: float = 0.1, degree: int = 16, width: int = 16, alpha: float = 1.1, heavy_share: float = 1e-3, per_shard: int = 32, most_shards: int = 1_000_000) -> DataFrame:
    """Pairs (a, b), a < b, of usable rows of one model of which at least one is among the k nearest of the other.

    ``rows``: id, embedding_model_version, embedding_dimensions, embedding. Rows without id or model, or whose vector is null, of
    another length, not finite or all zero, are left out; copies of an id count once. ``sample`` bounds the rows that fit the
    cells (all rows are indexed and searched); a cell of more than four times ``target`` ids is cut again, by ``per_shard`` sampled rows of
    it for each shard to come. The centroids go to every task, so more than ``most_shards`` of them are an error. Vectors that at least ``heavy_share`` of the sample has are the same are kept out
    of the shards but for their k + 1 least ids, which are the neighbours of all the others (a group of at most k ids stands there
    whole); so are vectors of more than ``target`` rows in a cell that is cut again. No group of equal vectors enters one task.
    """
    picked = rows.select(F.col(id_column).alias("id"), F.col("embedding_model_version").alias("model"), F.col("embedding_dimensions").alias("d"), "embedding")
    plans = shards(picked, k, sample, target, most_cells, margin, heavy_share, per_shard, most_shards)
    assigned = picked.mapInArrow(_assign(plans, margin), "model string, shard int, id string, twin boolean, vec binary")
    indexed = assigned.where("shard >= 0")
    heavy = any(p.heavy for p in plans.values())
    if heavy:
        shared = assigned.where("shard < 0").select("model", "shard", "id").distinct()
        order = Window.partitionBy("model", "shard").orderBy("id")
        least = shared.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("model", "shard", "id")
        # at most (k + 1) / heavy_share rows a model; they stand in the shards for all their equals
        stand = [(*r["model"].rsplit("/", 1), r["shard"], r["id"]) for r in least.collect()]
        rows = []
        for model, d, j, i in stand:
            plan = plans[model, int(d)]
            v = np.frombuffer(plan.heavy[-1 - j], np.float32)
            one, two, best, next_best = plan.place((v / np.linalg.norm(v.astype(np.float64))).astype(np.float32)[None, :])
            stands = [int(one[0])] + [int(two[0])] * bool(next_best[0] >= best[0] - margin)
            rows += [(f"{model}/{d}", c, i, True, v.tobytes()) for c in stands]
        indexed = indexed.unionByName(picked.sparkSession.createDataFrame(rows, "model string, shard int, id string, twin boolean, vec binary"))
    edges = indexed.groupBy("model", "shard").applyInArrow(_pairs(k, degree, width, alpha), "a string, b string, similarity double")
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    # the same edge from two shards counts once
    opened = edges.where(F.col("similarity").isNotNull()).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    merged = opened.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("a", "b")
    out = edges.where(F.col("similarity").isNull()).select("a", "b").unionByName(merged)
    if heavy:
        # k + 1 ids each; all ids of a smaller group stand in the shards, whose edges fill up to k
        top = least.groupBy("model", "shard").agg(F.array_sort(F.collect_list("id")).alias("top")).where(F.size("top") > k)
        full = shared.join(top, ["model", "shard"])
        others = full.select(F.col("id").alias("a"), F.explode(F.slice(F.array_remove("top", F.col("id")), 1, k)).alias("b"))
        known = full.select(F.col("id").alias("a")).distinct()
        out = edges.where(F.col("similarity").isNull()).select("a", "b").unionByName(merged.join(known, "a", "left_anti")).unionByName(others)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
