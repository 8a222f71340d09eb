"""Assertions of a lineage in order: interval relations, deduplication and the ordered fold to statuses."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions.text import squeeze, trimmed_key

CERTAIN = 0.8


def relation(a_start: Column, a_end: Column, a_sure: Column, b_start: Column, b_end: Column, b_sure: Column) -> Column:
    """BEFORE, AFTER or OVERLAPS of two half-open intervals; INDETERMINATE where a bound that decides is open or a time unsure."""
    none_a, none_b = a_start.isNull() & a_end.isNull(), b_start.isNull() & b_end.isNull()
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    return (
        F.when(~a_sure | ~b_sure | none_a | none_b, "INDETERMINATE")
        .when(a_end <= b_start, "BEFORE").when(a_start >= b_end, "AFTER").when(known, "OVERLAPS").otherwise("INDETERMINATE")
    )


def sure(precision: Column, confidence: Column) -> Column:
    return F.coalesce((precision != "UNKNOWN") & (confidence >= CERTAIN), F.lit(False))


def version_relations(versions: DataFrame) -> DataFrame:
    """Each version's validity against that of the version before it in its lineage: one window, no pairs of all versions."""
    w = Window.partitionBy("memory_id").orderBy("version_number", "version_id")
    v = versions.select("memory_id", "version_id", "version_number", F.struct(F.col("valid_time_start").alias("s"), F.col("valid_time_end").alias("e"), sure(F.col("valid_time_precision"), F.col("confidence")).alias("k"), "version_id").alias("a"))
    j = v.withColumn("b", F.lag("a").over(w)).where(F.col("b").isNotNull())
    rel = relation(*(F.col(f"{t}.{c}") for t in "ab" for c in ("s", "e", "k")))
    return j.select("memory_id", "version_id", F.col("b.version_id").alias("earlier_version_id"), rel.alias("relation"))


def duplicates(versions: DataFrame) -> DataFrame:
    """Versions that repeat an earlier one of their lineage: EXACT if value and squeezed content are equal, PARAPHRASE if the value is.

    The first of each value is found by a partial aggregate, so a value repeated many times stays cheap.
    """
    v = versions.select("memory_id", "version_id", "version_number", "value_json", squeeze(F.coalesce("normalized_content", F.lit(""))).alias("content")).where(F.col("value_json").isNotNull())
    first = v.groupBy("memory_id", "value_json").agg(F.min(F.struct("version_number", "version_id", "content")).alias("f"))
    kind = F.when(F.col("content") == F.col("f.content"), "EXACT").otherwise("PARAPHRASE")
    return v.join(first, ["memory_id", "value_json"]).where(F.col("version_id") != F.col("f.version_id")).select("memory_id", "version_id", F.col("f.version_id").alias("repeats_version_id"), kind.alias("assessment"))


@dataclass(eq=False)
class Kept:
    """A version that the fold still has to look at."""

    version_id: str
    value: str | None
    content: str
    start: int | None
    end: int | None
    certain: bool
    status: str

    @property
    def bounded(self) -> bool:
        return self.certain and self.start is not None and self.end is not None


class Fold:
    """One lineage: plans each assertion against the retained versions.

    Values are looked up in a dictionary. Certain, bounded intervals lie sorted by start with the greatest end so far, so that only those
    that overlap are visited; the few others are walked through. Versions that an operation leaves as they are cost nothing.
    """

    def __init__(self, single: bool, kept: Iterable[Kept] = (), candidates: Iterable[str] = ()) -> None:
        self.single, self.kept, self.candidates = single, {}, set(candidates)
        self._values: dict[str | None, Kept] = {}
        self._sorted: list[tuple[int, int, Kept]] = []  # (start, count, version)
        self._reach: list[int] = []  # the greatest end up to each place
        self._loose: dict[str, Kept] = {}
        self._calm: dict[str, Kept] = {}  # not CONFLICTED
        self._live: dict[str, Kept] = {}  # not HISTORICAL
        self._added = 0
        for v in kept:
            self._keep(v)

    def _keep(self, v: Kept) -> None:
        self.kept[v.version_id] = v
        self._values.setdefault(v.value, v)
        self._note(v)
        if not v.bounded:
            self._loose[v.version_id] = v
            return
        self._added += 1
        at = bisect_left(self._sorted, (v.start, self._added))
        self._sorted.insert(at, (v.start, self._added, v))
        self._reach.insert(at, 0)
        self._extend(at)

    def _extend(self, at: int) -> None:
        for k in range(at, len(self._sorted)):
            reach = max(self._sorted[k][2].end, self._reach[k - 1] if k else self._sorted[k][2].end)
            if self._reach[k] == reach and k > at:
                break
            self._reach[k] = reach

    def _note(self, v: Kept) -> None:
        for held, status in ((self._calm, "CONFLICTED"), (self._live, "HISTORICAL")):
            held.pop(v.version_id, None)
            if v.status != status:
                held[v.version_id] = v

    def _set(self, v: Kept, status: str) -> tuple[str, str, str]:
        before, v.status = v.status, status
        self._note(v)
        return v.version_id, before, status

    def _clashes(self, new: Kept) -> tuple[list[Kept], bool]:
        """The retained versions that overlap the new one or cannot be told from it, and whether it lies before one."""
        if not new.bounded:
            relations = [(v, self.relation(new, v)) for v in self.kept.values()]
        else:
            relations = [(v, self.relation(new, v)) for v in self._loose.values()]
        clash = [v for v, r in relations if r in ("OVERLAPS", "INDETERMINATE")]
        before = any(r == "BEFORE" for _, r in relations)
        if new.bounded and self._sorted:
            before = before or self._sorted[-1][0] >= new.end
            k = bisect_left(self._sorted, (new.end,)) - 1
            while k >= 0 and self._reach[k] > new.start:
                v = self._sorted[k][2]
                if self.relation(new, v) == "OVERLAPS":
                    clash.append(v)
                k -= 1
        return clash, before

    def plan(self, new: Kept, candidate: str | None = None) -> tuple[str, str | None, list[tuple[str, str, str]]]:
        """Operation, the new version's id (of a repeat, the one it reinforces) and the status changes of earlier versions, by id.

        A candidate that the lineage has seen is ignored.
        """
        if candidate is not None:
            if candidate in self.candidates:
                return "IGNORE", None, []
            self.candidates.add(candidate)
        if new.value in self._values:
            return "REINFORCE", self._values[new.value].version_id, []
        changes: list[tuple[str, str, str]] = []
        if not self.kept:
            operation, new.status = "CREATE", "CURRENT"
        elif not self.single:
            operation, new.status = "COEXIST", "CURRENT"
        else:
            clash, before = self._clashes(new)
            if clash:
                operation, new.status = "CONFLICT", "CONFLICTED"
                changes = [self._set(v, "CONFLICTED") for v in clash if v.status != "CONFLICTED"]
            elif before:
                operation, new.status = "SUPERSEDE", "HISTORICAL"  # filled in behind what is known
            else:
                operation, new.status = "SUPERSEDE", "CURRENT"
                changes = [self._set(v, "HISTORICAL") for v in list(self._live.values())]
        self._keep(new)
        return operation, new.version_id, sorted(changes)

    def invalidate(self, version_id: str, replacement: Kept | None = None) -> list[tuple[str, str, str]]:
        """INVALIDATED is final and no longer retained; a replacement takes over the status."""
        gone = self.kept.get(version_id)
        if gone is None:
            raise ValueError(f"no retained version {version_id}")
        before = gone.status
        rest = []
        for v in self.kept.values():
            rest += [v] if v is not gone else [replacement] * (replacement is not None)
        if replacement is not None:
            replacement.status = before
        gone.status = "INVALIDATED"
        self.__init__(self.single, rest, self.candidates)
        return [(version_id, before, "INVALIDATED")]

    @staticmethod
    def relation(a: Kept, b: Kept) -> str:
        if not (a.certain and b.certain) or (a.start is None and a.end is None) or (b.start is None and b.end is None):
            return "INDETERMINATE"
        if a.end is not None and b.start is not None and a.end <= b.start:
            return "BEFORE"
        if a.start is not None and b.end is not None and a.start >= b.end:
            return "AFTER"
        return "OVERLAPS" if None not in (a.start, a.end, b.start, b.end) else "INDETERMINATE"


_OUT = "memory_id string, version_id string, operation string, subject_version_id string, new_status string, changes array<struct<version_id:string,from_status:string,to_status:string>>"
_CHANGE = pa.struct([("version_id", pa.string()), ("from_status", pa.string()), ("to_status", pa.string())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, fold = None, Fold(True)
    for batch in batches:
        rows: list[tuple] = []
        changed: list[tuple[str, str, str]] = []
        offsets = [0]
        for memory, version, single, value, candidate, start, end, certain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if memory != key:
                key, fold = memory, Fold(single)
            new = Kept(version, value, "", start, end, certain, "")
            operation, subject, changes = fold.plan(new, candidate)
            rows.append((memory, version, operation, subject, new.status or None))
            changed += changes
            offsets.append(len(changed))
        if rows:
            parts = list(zip(*changed, strict=True)) or [(), (), ()]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in parts], fields=list(_CHANGE)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*rows, strict=True)), lists], names=["memory_id", "version_id", "operation", "subject_version_id", "new_status", "changes"])


def fold(versions: DataFrame, lineages: DataFrame) -> DataFrame:
    """The transition of every version: operation, status and changes of earlier versions of its lineage.

    Versions stream through each task sorted by lineage and number, so a task holds one lineage's retained versions at a time,
    whatever the number of rows. Copies count once; versions without a lineage are left out; a blank candidate_id counts as none,
    and so does a table without that column.
    """
    v = versions.dropDuplicates(["version_id"]).where(F.col("version_id").isNotNull())
    kinds = lineages.groupBy("memory_id").agg(F.min("predicate_cardinality").alias("cardinality"))
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    candidate = trimmed_key(F.col("candidate_id")) if "candidate_id" in v.columns else F.lit(None).cast("string")
    rows = v.join(kinds, "memory_id").select(
        "memory_id", "version_number", "version_id", F.coalesce(F.col("cardinality") == "SINGLE", F.lit(False)).alias("single"), "value_json", candidate.alias("candidate"),
        time("valid_time_start").alias("s"), time("valid_time_end").alias("e"), sure(F.col("valid_time_precision"), F.col("confidence")).alias("k"),
    )
    in_order = rows.repartition("memory_id").sortWithinPartitions("memory_id", "version_number", "version_id")
    return in_order.select("memory_id", "version_id", "single", "value_json", "candidate", "s", "e", "k").mapInArrow(_stream, _OUT)


def closed_form(intervals: DataFrame) -> DataFrame:
    """Final statuses of SINGLE lineages whose versions arrive in order of start with certain, bounded intervals, without a fold.

    Rows (lineage, n, s, e, value): repeats of a value are dropped, a version that overlaps an earlier one is a conflict, and
    the last version that does not is current unless a later one overlaps it.
    """
    first = intervals.groupBy("lineage", "value").agg(F.min(F.struct("n", "s", "e")).alias("f")).select("lineage", "value", "f.*")
    whole = Window.partitionBy("lineage")
    before = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    known = first.withColumn("conflict", F.coalesce(F.max("e").over(before) > F.col("s"), F.lit(False)))
    known = known.withColumn("last", F.max(F.when(~F.col("conflict"), F.col("n"))).over(whole))
    known = known.withColumn("next", F.min(F.when(F.col("n") > F.col("last"), F.col("s"))).over(whole))
    hit = (F.col("n") > F.col("last")) | F.coalesce(F.col("e") > F.col("next"), F.lit(False))
    status = F.when(hit, "CONFLICTED").when(F.col("n") == F.col("last"), "CURRENT").otherwise("HISTORICAL")
    return known.select("lineage", "n", "value", status.alias("status"))
