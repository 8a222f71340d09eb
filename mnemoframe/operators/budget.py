"""Ordered folds over sorted partitions: context selection under a budget.

Rows are spread by ranges of key and order, so a key of any number of rows lies in several neighbouring tasks. What is left of the budget at
the start of a task follows from what the tasks before make of it: each that holds one key only says, for every amount used before, how
much is used after; these few step functions are put one after the other, then the tasks choose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.session import cut_lineage


def _fold(used: int, sizes: list[int], budget: int) -> tuple[int, list[int], list[int]]:
    keep, total = [], []
    for k, size in enumerate(sizes):
        if used + size <= budget:
            used += size
            keep.append(k)
            total.append(used)
    return used, keep, total


def _ends(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task its number, first and last key's hash, what the last key uses if it begins here, and else the step function as (from, used after) runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        used, states, any_row = 0, np.arange(budget + 1), False
        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not any_row or key != last:
                    if any_row:
                        states = None  # more than one key: the first one's function is of no use
                    else:
                        first, any_row = key, True
                    last, used = key, 0
                if used + size <= budget:
                    used += size
                if states is not None and size:
                    fits = states + size <= budget
                    states[fits] += size
        if any_row:
            at = [] if states is None else np.flatnonzero(np.diff(states, prepend=-9) != 1)
            # a run is where input and output rise together; the rest follows from its start
            steps = [] if states is None else [(int(k), int(states[k])) for k in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([used], pa.int64()), pa.array([[s[0] for s in steps]], pa.list_(pa.int64())), pa.array([[s[1] for s in steps]], pa.list_(pa.int64()))],
                names=["task", "first", "last", "used", "from", "to"],
            )

    return run


def starts(ends: list) -> dict[int, int]:
    """What each task's first key has used before it, by task."""
    out, key, used = {}, None, 0
    for r in sorted(ends, key=lambda r: r["task"]):
        out[r["task"]] = used if r["first"] == key else 0
        if r["first"] == r["last"] and r["from"]:
            k = int(np.searchsorted(r["from"], out[r["task"]], side="right")) - 1
            used = r["to"][k] + out[r["task"]] - r["from"][k]
        else:
            used = r["used"]
        key = r["last"]
    return out


def _choose(budget: int, before: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key, used = object(), 0
        begun = False
        for batch in batches:
            hashes, sizes = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(hashes)) + 1).tolist(), len(hashes)]
            keep, total = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if hashes[a] != key:
                    key, used = hashes[a], 0 if begun else before.get(TaskContext.get().partitionId(), 0)
                begun = True
                used, some, sums = _fold(used, sizes[a:b], budget)
                keep += [a + k for k in some]
                total += sums
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(3), pa.array(total, pa.int64())], names=["key", "item", "size", "used"])

    return run


def choose(df: DataFrame, key: str, item: str, size: Column, budget: int, *order: Column, partitions: int | None = None) -> DataFrame:
    """Items of each key in order while they fit; one that does not is skipped and later ones are still tried.

    Later in ``order`` comes first, ties go to the smaller item, nulls come last. A null size counts as 0; items above the budget are left
    out before anything is shuffled. No task holds more than its range of rows, whatever the keys. Keys are told apart by a 64-bit hash.
    """
    rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("key"), F.col(item).alias("item"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), *(o.alias(f"o{k}") for k, o in enumerate(order)))
    kinds = dict(rows.dtypes)
    by = ["h", *(F.col(f"o{k}").desc_nulls_last() for k in range(len(order))), "item"]
    fitting = rows.where(F.col("size") <= budget)
    spread = fitting.repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions(*by).select("h", "key", "item", "size")
    held = cut_lineage(spread)  # both passes have to see the same tasks
    before = starts(held.mapInArrow(_ends(budget), "task int, first long, last long, used long, from array<long>, to array<long>").collect())
    out = held.mapInArrow(_choose(budget, before), f"key {kinds['key']}, item {kinds['item']}, size long, used long")
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item)
