"""Filling fixed-capacity containers (problem 7) by Karmarkar-Karp multiway differencing.

Each map task packs the texts it reads, in blocks of a few thousand, so nothing is shuffled and no group grows with the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mnemoframe.llm.tokens import TOKENIZER_DIR, budgets, sizer

SCHEMA = "doc_id {kind}, capacity_tokens int, container_id string, part_no int, token_start int, n_tokens int"


def differencing(sizes: list[int], ways: int) -> np.ndarray:
    """The way of each item: near-equal sums by repeatedly merging the two partial partitions of largest spread, largest against smallest."""
    n = len(sizes)
    if ways == 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n  # nodes below n are items, the others join two nodes
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for k in sorted(range(n), key=lambda k: -sizes[k]):
        # sums ascend; only the occupied end is kept, the slots before it are empty
        heap.append((-sizes[k], k, np.array([sizes[k]], np.int64), np.array([k], np.int64)))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        a, b = len(s1), len(s2)
        if a + b <= ways:
            s, m = np.concatenate([s1, s2]), np.concatenate([m1, m2])
        else:
            # slots ascend in s1 and descend in s2: the largest of one meets the smallest of the other
            both = a + b - ways
            s = np.concatenate([s1[:both] + s2[:both][::-1], s1[both:], s2[both:]])
            fresh = np.arange(len(left), len(left) + both)
            left.extend(m1[:both].tolist())
            right.extend(m2[:both][::-1].tolist())
            m = np.concatenate([fresh, m1[both:], m2[both:]])
        order = np.argsort(s, kind="stable")
        s, m = s[order], m[order]
        spread = int(s[-1] - (s[0] if len(s) == ways else 0))
        heapq.heappush(heap, (-spread, tick, s, m))
        tick += 1
    way = np.zeros(n, np.int64)
    for slot, node in enumerate(heap[0][3].tolist()):
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                way[x] = slot
            else:
                stack += (left[x], right[x])
    return way


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """The container of each item of at most ``capacity``; the number of windows rises until none exceeds the capacity."""
    total = sum(sizes)
    ways = max(1, -(-total // capacity))
    while True:
        way = differencing(sizes, ways)
        fullest = int(np.bincount(way, weights=sizes, minlength=1).max()) if len(sizes) else 0
        if fullest <= capacity:
            return way
        ways = max(ways + 1, ways * fullest // capacity) if ways < len(sizes) else ways + 1


def _packer(capacities: list[int], name: str, folder: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding, task = sizer(name, folder), TaskContext.get().partitionId()
        ids: list[object] = []
        sizes: list[int] = []
        begun = 0
        kind = pa.int64()

        def flush(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal begun
            part, weights = ids[:upto], sizes[:upto]
            del ids[:upto], sizes[:upto]
            for capacity in capacities:
                rest = [w % capacity if w > capacity else w for w in weights]
                way = pack(rest, capacity).tolist()
                most, rows = max(way, default=-1) + 1, []
                for doc, w, r, c in zip(part, weights, rest, way, strict=True):
                    whole = (w - r) // capacity
                    for k in range(whole):
                        rows.append((doc, f"{capacity}-{task}-{begun}-{most}", k, k * capacity, capacity))
                        most += 1
                    if r or not w:
                        rows.append((doc, f"{capacity}-{task}-{begun}-{c}", whole, whole * capacity, r))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], kind), pa.array([capacity] * len(rows), pa.int32()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int32()) for c in cols[2:])],
                    names=["doc_id", "capacity_tokens", "container_id", "part_no", "token_start", "n_tokens"],
                )
            begun += 1

        for batch in batches:
            kind = batch.column(0).type
            ids += batch.column(0).to_pylist()
            sizes += [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(1).to_pylist()]
            while len(ids) >= 2 * block:
                yield from flush(block)
        if ids:
            yield from flush(len(ids))

    return run


def containers(docs: DataFrame, budget: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, block: int = 3000) -> DataFrame:
    """Every text in containers of each container capacity of the budget table (a few rows), as token ranges.

    A text over the capacity is cut into full containers and a rest, which is packed with the others; no other is cut.
    A null or empty text takes no room and lies in some container of its block with a size of 0. Copies are packed one by one.
    An empty table gives no rows. Container ids name the capacity, the map task, its block and the window, so they follow the splits of the
    input: they are unique within a result, and another run over other splits packs otherwise.
    """
    capacities = sorted({r[0] for r in budgets(budget, "container", name, ("capacity_tokens",)) if r[0] and r[0] > 0})
    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("doc_id"), text_column).mapInArrow(_packer(capacities, name, folder, block), SCHEMA.format(kind=kind))
    return out.withColumnRenamed("doc_id", id_column)
