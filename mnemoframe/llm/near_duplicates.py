"""Near-duplicate statements (problem 1) by a grouped prefix join, exact for Jaccard similarity of character trigrams.

Statements equal after normalising are one class. Trigrams are ordered from rare to frequent by a sketch of counts over all statements;
two sets that are similar enough share one of their first, rarest trigrams. Classes with the same prefix and size are one group;
groups that meet in the prefix index pass a bound on the overlap still possible, then their members are verified. A large
predicate is cut by set size into blocks of equal weight; every two blocks whose sizes allow it meet in one task, which holds these two only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mnemoframe.functions.text import WHITE_SPACE
from mnemoframe.session import cut_lineage

BUCKETS = 1 << 16
EXTRA = 8  # trigrams indexed beyond the least number; more of them make the bound on the overlap sharper


def normalised(c: F.Column) -> F.Column:
    """Lower case, each run of characters other than letters and numbers as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams of the texts as integers (21 bits a code point), as often as they stand, and the text of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside = doc[:-2] == doc[2:]
    return codes[inside], doc[:-2][inside]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of each text in order, one text after the other, and where each text begins."""
    codes, doc = windows(texts)
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    codes, doc = codes[new], doc[new]
    return codes, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])


def bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        codes, _ = windows([t for t in batch.column(0).to_pylist() if t])
        total += np.bincount(bucket(codes), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def frequencies(texts: DataFrame) -> np.ndarray:
    """Counts of trigrams over all texts, in a sketch of fixed size; only the join's speed depends on them."""
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r[0]] = r[1]
    return out


def _prefix(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + (size > 0)


def join(texts: list[str], seen: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of the texts with their similarity of at least ``threshold``; with ``side`` (0 or 1 per text), those of different sides."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    known = np.unique(np.concatenate([np.unique(windows(texts[at : at + 4096])[0]) for at in range(0, max(1, len(texts)), 4096)]))
    if not len(known):
        return none
    rank_of = np.empty(len(known), np.int64)
    rank_of[np.lexsort((known, seen[bucket(known)]))] = np.arange(len(known))
    parts, sizes = [], []
    for at in range(0, len(texts), 4096):  # sorting takes several times the room of its result
        codes, doc = windows(texts[at : at + 4096])
        key = np.sort(doc * len(known) + rank_of[np.searchsorted(known, codes)])
        key = key[np.diff(key, prepend=-1) > 0]
        doc, rank = np.divmod(key, len(known))
        parts.append(rank.astype(np.int32))
        sizes.append(np.bincount(doc, minlength=min(4096, len(texts) - at)))
    ranks, size = np.concatenate(parts), np.concatenate(sizes)
    begin = np.concatenate([[0], np.cumsum(size)])
    del parts
    side = np.zeros(len(texts), np.int8) if (whole := side is None) else side

    # groups: classes of one prefix and one size, in order of size
    docs = np.argsort(size, kind="stable")
    docs = docs[size[docs] > 0]
    places: dict[tuple[int, int, bytes], int] = {}
    members: list[list[int]] = []
    length = _prefix(size, threshold)
    for d in docs.tolist():
        key = int(side[d]), int(size[d]), ranks[begin[d] : begin[d] + length[d]].tobytes()
        g = places.setdefault(key, len(members))
        if g == len(members):
            members.append([])
        members[g].append(d)
    head = np.array([m[0] for m in members])
    count = len(head)
    g_size, g_len = size[head], length[head]
    last = ranks[begin[head] + g_len - 1]

    # the prefix index: postings of groups by trigram; the smaller of two sets needs fewer of its trigrams there
    i_len = np.minimum(g_len, g_size - np.ceil(2 * threshold / (1 + threshold) * g_size - 1e-9).astype(np.int64) + EXTRA)
    last_indexed = ranks[begin[head] + i_len - 1]
    flat = np.concatenate([ranks[begin[h] : begin[h] + n] for h, n in zip(head.tolist(), g_len.tolist(), strict=True)])
    group = np.repeat(np.arange(count), g_len)
    indexed = np.arange(len(flat)) - np.repeat(np.cumsum(g_len) - g_len, g_len) < np.repeat(i_len, g_len)
    g_side = side[head]
    keys, posts = [], []
    for k in (0, 1):  # the other side's groups are what a group may meet; without sides all are
        mine = indexed & (g_side[group] == k) if not whole else indexed
        keys.append(np.sort(flat[mine].astype(np.int64) * count + group[mine]))
        posts.append((keys[k] % count).astype(np.int32))
        if whole:
            break
    starts = np.concatenate([[0], np.cumsum(g_len)])
    lowest = np.searchsorted(g_size, np.ceil(threshold * g_size - 1e-9))

    one, two, sims = [], [], []

    def verify(d: np.ndarray, other: np.ndarray) -> None:
        """Keeps the pairs that are similar enough; some of the texts ``d`` at a time are marked."""
        by = np.argsort(d, kind="stable")
        other = other[by]
        texts_, which = np.unique(d[by], return_inverse=True)
        most = max(1, (1 << 25) // len(known))
        for low in range(0, len(texts_), most):
            at, end = np.searchsorted(which, [low, low + most])
            mine = texts_[low : low + most]
            mark = np.zeros((len(mine), len(known)), bool)
            n = size[mine]
            mark[np.repeat(np.arange(len(mine)), n), ranks[np.arange(n.sum()) + np.repeat(begin[mine] - (np.cumsum(n) - n), n)]] = True
            for k in range(at, end, 50_000):
                row, o = which[k : min(end, k + 50_000)] - low, other[k : min(end, k + 50_000)]
                n = size[o]
                ends = np.cumsum(n)
                token = ranks[np.arange(ends[-1]) + np.repeat(begin[o] - (ends - n), n)]
                shared = np.add.reduceat(mark[np.repeat(row, n), token], ends - n, dtype=np.int64)
                sim = shared / (n + size[mine[row]] - shared)
                good = sim >= threshold
                one.append(mine[row[good]])
                two.append(o[good])
                sims.append(sim[good])

    rest, rest_indexed = g_size - g_len, g_size - i_len
    share = threshold / (1 + threshold)

    def _possible(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        # what can still be shared lies behind the prefix that ends first
        behind = np.where(last[a] < last_indexed[b], rest[a], rest_indexed[b])
        return common + behind >= np.ceil(share * (g_size[a] + g_size[b]) - 1e-9)

    several = [np.array(m) for m in members]
    wide, f_size, f_rest, f_indexed = len(head) < len(docs), *(x.astype(np.float32) for x in (g_size * share, rest, rest_indexed))
    block = max(1, (1 << 21) // count)
    for low in range(0, count, block):
        high = min(count, low + block)
        tokens, probe = flat[starts[low] : starts[high]], group[starts[low] : starts[high]] - low
        met = np.zeros((high - low) * high, np.int32)  # a group meets those before it
        for k in range(len(keys)):
            mine = slice(None) if whole else g_side[probe + low] != k
            own, by = tokens[mine], probe[mine]
            if not len(own) or not len(keys[k]):
                continue
            base = own.astype(np.int64) * count
            first = np.searchsorted(keys[k], base + lowest[by + low])
            n = np.searchsorted(keys[k], base + by + low) - first  # earlier groups that are large enough
            ends = np.cumsum(n)
            at = np.arange(ends[-1], dtype=np.int32) + np.repeat((first - (ends - n)).astype(np.int32), n)
            met += np.bincount(posts[k][at] + np.repeat((by * high).astype(np.int32), n), minlength=len(met)).astype(np.int32)
        # a bound by rows and columns first, then the exact one
        met = met.reshape(high - low, high)
        need = f_size[low:high, None] + f_size[None, :high] - np.maximum(f_rest[low:high, None], f_indexed[None, :high])
        a, b = np.nonzero(met >= np.maximum(need - 0.01, 1))
        a, common = a + low, met[a, b]
        ok = _possible(a, b, common)
        a, b = a[ok], b[ok]
        if not wide:
            verify(head[a], head[b])
            continue
        left, right = [], []
        edges = np.searchsorted(a, np.arange(low, high + 1))
        for g in range(low, high):
            mine = several[g]
            some = [several[h] for h in b[edges[g - low] : edges[g - low + 1]].tolist()]
            for k, d in enumerate(mine.tolist()):
                others = np.concatenate([*some, mine[:k] if whole else mine[:0]])
                left.append(np.full(len(others), d))
                right.append(others)
        verify(np.concatenate(left), np.concatenate(right).astype(np.int64))
    return (np.concatenate(one), np.concatenate(two), np.concatenate(sims)) if one else none


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join two parts that earlier ones left apart: as few links with the same components."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            parent[x] = y
            keep[k] = True
    return keep


LINKS = "a string, b string, similarity double, n_links long"


def _joiner(seen: np.ndarray, threshold: float, summed: bool) -> Callable[[pa.Table], pa.Table]:
    """Linked pairs of a task; ``summed``: links enough to span their components, and rows (a, null, null, n) with each class's number of links."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = rows["block"].to_numpy()
        crossing = rows["i"][0].as_py() != rows["j"][0].as_py()
        a, b, s = join(rows["norm"].to_pylist(), seen, threshold, (blocks == rows["j"][0].as_py()).astype(np.int8) if crossing else None)
        rep = rows["rep"].combine_chunks()
        name = lambda at: rep.take(pa.array(at)).cast(pa.string())
        none = lambda n: pa.nulls(n, pa.int64())
        if not summed:
            return pa.table({"a": name(a), "b": name(b), "similarity": pa.array(s, pa.float64()), "n_links": none(len(a))})
        keep = _spanning(a, b)
        nodes, n = np.unique(np.concatenate([a, b]), return_counts=True)
        links = pa.table({"a": name(a[keep]), "b": name(b[keep]), "similarity": pa.array(s[keep], pa.float64()), "n_links": none(int(keep.sum()))})
        return pa.concat_tables([links, pa.table({"a": name(nodes), "b": pa.nulls(len(nodes), pa.string()), "similarity": pa.nulls(len(nodes), pa.float64()), "n_links": pa.array(n, pa.int64())})])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, begin = trigrams(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(begin), pa.int64())], names=["pred", "rep", "norm", "size"])


def statements(candidates: DataFrame) -> DataFrame:
    """Rows (id, pred, norm); those with a null id, predicate or content are left out."""
    return candidates.select(F.col("candidate_id").alias("id"), F.lower(F.btrim("predicate", F.lit(WHITE_SPACE))).alias("pred"), normalised(F.col("normalized_content")).alias("norm")).dropna()


def classes(rows: DataFrame) -> DataFrame:
    """One row per predicate and normalised content: its least id ``rep`` and greatest ``last``."""
    return rows.groupBy("pred", "norm").agg(F.min("id").alias("rep"), F.max("id").alias("last"))


def blocks(sized: DataFrame, room: int) -> DataFrame:
    """Adds ``block``: by size of the trigram set, blocks of a predicate weigh about ``room`` each, however its sizes are spread.

    Where blocks begin comes from a running sum over the counts by size; statements of one size are spread by hash.
    """
    order = Window.partitionBy("pred").orderBy("size")
    spread = sized.groupBy("pred", "size").agg(F.sum("weight").alias("w")).withColumn("upto", F.sum("w").over(order)).select("pred", "size", "w", "upto")
    place = F.col("upto") - F.col("w") * (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) + 1) / (1 << 20)
    return sized.join(spread, ["pred", "size"]).withColumn("block", F.floor(place / room).cast("int")).drop("w", "upto")


def meetings(blocked: DataFrame, threshold: float) -> DataFrame:
    """A row of each block for each task (i, j), i <= j, in which it meets another: those whose sizes allow a pair, and its own."""
    ends = blocked.groupBy("pred", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    x, y = ends.alias("x"), ends.alias("y")
    near = (F.col("x.pred") == F.col("y.pred")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.most") >= F.ceil(F.col("y.least") * threshold - 1e-9))
    tasks = x.join(y, near).select("x.pred", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = tasks.select("pred", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return blocked.join(sides, ["pred", "block"]).select("pred", "i", "j", "block", "rep", "norm")


def similar_classes(every: DataFrame, threshold: float, rows_per_task: int, summed: bool = False) -> DataFrame:
    """Pairs (a, b, similarity) of class representatives with different contents, or with ``summed`` what :func:`_joiner` says.

    ``rows_per_task``: how many statements of 160 characters a task may hold; longer ones count as more.
    """
    seen = frequencies(every.select("norm"))
    weight = F.greatest(F.lit(1.0), F.length("norm") / 160)
    names = ["pred", "i", "j", "block", "rep", "norm"]
    sums = every.groupBy("pred").agg(F.sum(weight).alias("total"))
    marked = every.select("pred", "rep", "norm").join(sums, "pred")
    whole = marked.where(F.col("total") <= rows_per_task).select("pred", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "rep", "norm")
    large = marked.where(F.col("total") > rows_per_task).select("pred", "rep", "norm")
    sized = large.mapInArrow(_sizes, "pred string, rep string, norm string, size long").where("size > 0").withColumn("weight", weight)
    if sums.where(F.col("total") > rows_per_task).isEmpty():
        routed = whole
    else:  # a task holds two blocks
        routed = whole.unionByName(meetings(cut_lineage(blocks(sized, max(1, rows_per_task // 2))), threshold)).select(*names)
    # groups differ much in cost: more partitions than usual, which adaptive execution leaves apart
    spread = routed.repartition(4 * int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pred", "i", "j")
    return spread.groupBy("pred", "i", "j").applyInArrow(_joiner(seen, threshold, summed), LINKS)


def similar_pairs(candidates: DataFrame, threshold: float = 0.7, rows_per_task: int = 20_000) -> DataFrame:
    """All pairs (candidate_id_a, candidate_id_b), a < b, of different ids whose statements are similar enough.

    Contents shorter than three characters after normalising have no trigrams and are in no pair. Copies of an id count once.
    """
    rows = statements(candidates)
    every = cut_lineage(classes(rows))
    several = every.where((F.col("rep") != F.col("last")) & (F.length("norm") >= 3)).select("pred", "norm", "rep")
    members = rows.join(several, ["pred", "norm"]).select("rep", "id").distinct()
    links = similar_classes(every, threshold, rows_per_task).select("a", "b").unionByName(several.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left, right = (members.select(F.col("rep").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
    pairs = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("id_a", "a").alias("x"), F.coalesce("id_b", "b").alias("y")).where("x != y")
    return pairs.select(F.least("x", "y").alias("candidate_id_a"), F.greatest("x", "y").alias("candidate_id_b")).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (node, root) of the connected components of links (a, b); every round is checkpointed.

    Each round points nodes at the least neighbour of their larger and smaller ones in turn, so paths shrink by halves.
    """

    def state(df: DataFrame) -> tuple:
        """Count and hash sum of the edges: equal when a round changed nothing, but for a chance of about one in 2^64."""
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    known = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        after = cut_lineage(down.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        edges, before, known = after, known, state(after)
        if known == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(candidates: DataFrame, threshold: float = 0.7, rows_per_task: int = 20_000) -> DataFrame:
    """One row per candidate: its class (equal statements), its group (linked classes) and the number of classes its class is linked to.

    Tasks count the links and hand on only as many as span their components, so the pairs within a large group are never listed.
    """
    rows = statements(candidates)
    every = cut_lineage(classes(rows))
    found = cut_lineage(similar_classes(every, threshold, rows_per_task, summed=True))
    links = found.where("b IS NOT NULL").select("a", "b")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    known = every.join(degree, "rep", "left").join(roots, "rep", "left").select("pred", "norm", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(known, ["pred", "norm"]).select(F.col("id").alias("candidate_id"), "class_id", "group_id", "n_links").distinct()
