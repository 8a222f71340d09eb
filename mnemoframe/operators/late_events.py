"""Per-hour counts by event time, corrected by late arrivals up to a cut-off (problem 3).

Events are reduced to their first arrival, spread over slabs of event time and salts of the id, and replayed in order of
arrival into a finger B-tree whose key is the hour. The cut-off evicts whole subtrees; what arrives for an evicted hour is set
apart as dropped. Totals of longer spans are read from the partials of ancestors before their hours are evicted. Hours of several salts
are sums of partials, so a hot hour never sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mnemoframe.functions.time import micros
from mnemoframe.operators.finger_tree import FingerTree

HOUR = 3_600_000_000
MINUTE = 60_000_000


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row per event id: its occurred_at and least received_at, in microseconds.

    Rows with a null id or without any received_at are no events; copies with a null occurred_at take that of the others.
    """
    return (
        events.select("source_event_id", micros(F.col("occurred_at")).alias("occurred"), micros(F.col("received_at")).alias("arrived"))
        .where(F.col("source_event_id").isNotNull())
        .groupBy("source_event_id")
        .agg(F.min("occurred").alias("occurred"), F.min("arrived").alias("arrived"))
        .where(F.col("occurred").isNotNull() & F.col("arrived").isNotNull())
    )


def _replay(grace: int, cutoff: int, per_event: bool) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        occurred = rows["occurred"].to_numpy()
        arrived = rows["arrived"].to_numpy()
        order = np.lexsort((occurred, arrived))
        hour = np.floor_divide(occurred, HOUR)[order]
        came = arrived[order]
        late = came > (hour + 1) * HOUR + grace
        floor = (came - cutoff - 1) // HOUR - 1  # the last hour whose cut-off has passed at this arrival
        tree, kept, closed = FingerTree(), np.ones(len(order), bool), []
        dropped: dict[int, int] = {}
        seen = None
        for i, (h, is_late, gone) in enumerate(zip(hour.tolist(), late.tolist(), floor.tolist(), strict=True)):
            if gone != seen:
                closed += tree.evict(gone)
                seen = gone
            if not tree.add(h, 0 if is_late else 1, 1 if is_late else 0):
                kept[i] = False
                dropped[h] = dropped.get(h, 0) + 1
        if per_event:
            shown = late | ~kept
            ids = rows["source_event_id"].take(pa.array(order[shown]))
            outcome = np.where(kept[shown], "corrected", "dropped")
            return pa.table({"source_event_id": ids.cast(pa.string()), "hour": pa.array(hour[shown], pa.int64()), "outcome": pa.array(outcome, pa.string())})
        sums = {h: [a, b, 0] for h, a, b in closed + tree.entries()}
        for h, n in dropped.items():
            sums.setdefault(h, [0, 0, 0])[2] += n
        keys = sorted(sums)
        return pa.table({"hour": pa.array(keys, pa.int64())} | {name: pa.array([sums[k][i] for k in keys], pa.int64()) for i, name in enumerate(("n_on_time", "n_corrected", "n_dropped"))})

    return run


def _spans(grace: int, cutoff: int, span: int) -> Callable[[pa.Table], pa.Table]:
    """Totals of spans of hours, each read from the tree by its ancestors' partials when the cut-off of its last hour has passed."""

    def run(rows: pa.Table) -> pa.Table:
        occurred, arrived = rows["occurred"].to_numpy(), rows["arrived"].to_numpy()
        order = np.lexsort((occurred, arrived))
        hour, came = np.floor_divide(occurred, HOUR)[order], arrived[order]
        late = came > (hour + 1) * HOUR + grace
        floor = (came - cutoff - 1) // HOUR - 1
        tree, out, dropped, open_ = FingerTree(), [], {}, set()

        def settle(upto: int | None) -> None:
            for k in sorted(x for x in open_ if upto is None or (x + 1) * span - 1 <= upto):
                out.append((k, *tree.range_sum(k * span, (k + 1) * span - 1)))
                open_.discard(k)

        seen = done = None
        for h, is_late, gone in zip(hour.tolist(), late.tolist(), floor.tolist(), strict=True):
            if gone != seen:
                seen = gone
                last = (gone + 1) // span * span - 1  # the last hour of the last whole span that has passed
                if last != done:
                    settle(last)
                    tree.evict(last)
                    done = last
            if h <= gone:
                dropped[h // span] = dropped.get(h // span, 0) + 1
            elif tree.add(h, 0 if is_late else 1, 1 if is_late else 0):
                open_.add(h // span)
        settle(None)
        sums = {k: [a, b, 0] for k, a, b in out}
        for k, n in dropped.items():
            sums.setdefault(k, [0, 0, 0])[2] += n
        keys = sorted(sums)
        return pa.table({"hour": pa.array([k * span for k in keys], pa.int64())} | {name: pa.array([sums[k][i] for k in keys], pa.int64()) for i, name in enumerate(("n_on_time", "n_corrected", "n_dropped"))})

    return run


def replay(events: DataFrame, grace_minutes: int = 15, cutoff_hours: int = 48, slab_hours: int = 24 * 7, rows_per_task: int = 250_000, per_event: bool = True, span: int = 1) -> DataFrame:
    """Rows (source_event_id, hour, outcome) of late events, or partials (hour, n_on_time, n_corrected, n_dropped) per hour or span of hours.

    Exactly the grace is on time, exactly the cut-off is still corrected. Each slab has as many salts as its rows need, so that no group
    exceeds ``rows_per_task`` by much even if one hour holds all rows, and small slabs are not split. An empty table gives no rows.
    """
    if slab_hours % span:
        raise ValueError("a slab must hold whole spans")
    schema = "source_event_id string, hour long, outcome string" if per_event else "hour long, n_on_time long, n_corrected long, n_dropped long"
    slab = lambda micros_: F.floor(micros_ / F.lit(slab_hours * HOUR))
    # copies count here too: at worst a slab is split more than it needs
    sizes = events.where(F.col("occurred_at").isNotNull()).groupBy(slab(micros(F.col("occurred_at"))).alias("slab")).agg(F.ceil(F.count("*") / rows_per_task).alias("salts"))
    run = _replay(grace_minutes * MINUTE, cutoff_hours * HOUR, per_event) if span == 1 else _spans(grace_minutes * MINUTE, cutoff_hours * HOUR, span)
    return (
        first_arrivals(events)
        .withColumn("slab", slab(F.col("occurred")))
        .join(sizes, "slab")
        .select("source_event_id", "occurred", "arrived", "slab", F.pmod(F.xxhash64("source_event_id"), F.col("salts")).alias("salt"))
        .groupBy("slab", "salt")
        .applyInArrow(run, schema)
    )


def _hour_text(hour: F.Column) -> F.Column:
    return F.date_format(F.timestamp_seconds(hour * 3600), "yyyy-MM-dd HH:00")


def late_events(events: DataFrame, **how: int) -> DataFrame:
    """The late events with their outcome: ``source_event_id, event_hour, outcome``."""
    return replay(events, per_event=True, **how).select("source_event_id", _hour_text(F.col("hour")).alias("event_hour"), "outcome")


def hourly_counts(events: DataFrame, **how: int) -> DataFrame:
    """Per hour: the count at first close, the corrections, the final count and the events set apart."""
    sums = replay(events, per_event=False, **how).groupBy("hour").agg(*(F.sum(c).alias(c) for c in ("n_on_time", "n_corrected", "n_dropped")))
    return sums.select(
        _hour_text(F.col("hour")).alias("event_hour"), F.col("n_on_time").alias("n_first"), "n_corrected",
        (F.col("n_on_time") + F.col("n_corrected")).alias("n_final"), "n_dropped",
    )


def daily_counts(events: DataFrame, **how: int) -> DataFrame:
    """The same per day, each day's total read from the tree's ancestors."""
    sums = replay(events, per_event=False, span=24, **how).groupBy("hour").agg(*(F.sum(c).alias(c) for c in ("n_on_time", "n_corrected", "n_dropped")))
    return sums.select(
        F.date_format(F.timestamp_seconds(F.col("hour") * 3600), "yyyy-MM-dd").alias("event_day"), F.col("n_on_time").alias("n_first"), "n_corrected",
        (F.col("n_on_time") + F.col("n_corrected")).alias("n_final"), "n_dropped",
    )
