from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import regex
from hypothesis import given, settings, strategies as st

from mnemoframe.llm import near_duplicates as nd

SCHEMA = "candidate_id string, predicate string, normalized_content string, id string, pred string, norm string, rep string, part int"


def grams(text):
    n = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()
    return {n[k : k + 3] for k in range(len(n) - 2)}


def brute(rows, threshold=0.7):
    known = {(i, p.strip().lower(), c) for i, p, c in rows if None not in (i, p, c)}
    out = set()
    for (i, p, c), (j, q, d) in combinations(sorted(known), 2):
        a, b = grams(c), grams(d)
        if i != j and p == q and a | b and len(a & b) / len(a | b) >= threshold:
            out.add((min(i, j), max(i, j)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", 1) for r in rows], SCHEMA)


def sample():
    rng = random.Random(4)
    words = "red green blue sofa table lamp 你好 北京 moves to in with 17 93 café naïve".split()
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        rows.append((f"c{k:03d}", rng.choice(["p.a", " P.A", "p.b"]), text))
        if rng.random() < 0.6:
            cut = list(text)
            for _ in range(rng.randint(0, 4)):
                cut[rng.randrange(len(cut))] = rng.choice("xyz .,!")
            rows.append((f"d{k:03d}", "p.a", "".join(cut)))
    edge = [("n1", None, "red sofa"), ("n2", "p.a", None), (None, "p.a", "red sofa"), ("e1", "p.a", ""), ("e2", "p.a", "  .. "), ("s1", "p.a", "ab"), ("s2", "p.a", "ab"), ("s3", "p.a", "abc"), ("s4", "p.a", "A-B_C abc")]
    long = "lorem ipsum dolor " * 4000
    return rows + edge + [("l1", "p.b", long), ("l2", "p.b", long + "sit amet")] + [rows[0], rows[1]]


def test_equals_brute_force(spark):
    rows = sample()
    want = brute(rows)
    assert len(want) > 30
    for per_task in (20_000, 40, 12):
        got = [tuple(r) for r in nd.similar_pairs(frame(spark, rows), rows_per_task=per_task).collect()]
        assert set(got) == want and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", max_size=14), max_size=25), st.sampled_from([0.5, 0.7, 0.8]), st.sampled_from([1, 2, 5]))
def test_join_is_exact_whatever_the_parts(texts, threshold, parts):
    texts = sorted({" ".join(t.split()) for t in texts})
    got, none = [], np.zeros(nd.BUCKETS, np.int64)
    for i in range(parts):
        for j in range(i, parts):  # every two of the parts
            own = [k for k in range(len(texts)) if k % parts in (i, j)]
            a, b, _ = nd.join([texts[k] for k in own], none, threshold, None if i == j else np.array([k % parts == j for k in own], np.int8))
            got += [(min(own[x], own[y]), max(own[x], own[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if (g := grams(texts[i])) | (h := grams(texts[j])) and len(g & h) / len(g | h) >= threshold}
    assert sorted(got) == sorted(want)


def test_groups(spark):
    rows = sample()
    got = nd.groups(frame(spark, rows)).toPandas()
    assert sorted(got.candidate_id) == sorted({r[0] for r in rows if None not in r})
    root = dict(zip(got.candidate_id, got.group_id, strict=True))
    parent = {c: c for c in root}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[top(a)] = top(b)
    ours, theirs = {}, {}
    for c in root:
        ours.setdefault(root[c], set()).add(c)
        theirs.setdefault(top(c), set()).add(c)
    # texts too short to have trigrams are one class when equal, but never linked
    short = {i for i, _, c in rows if c is not None and not grams(c)}
    assert sorted(map(sorted, (g for g in ours.values() if not g & short))) == sorted(map(sorted, (g for g in theirs.values() if not g & short)))


def test_empty(spark):
    assert nd.similar_pairs(frame(spark, [])).count() == 0 and nd.groups(frame(spark, [])).count() == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in nd.components(links).collect()}
    assert all(got[f"{k:03d}"] == "000" for k in range(1, 61)) and got["y"] == "x"


def test_tasks_hold_two_blocks_of_a_large_predicate(spark):
    rng = random.Random(7)
    texts = {f"c{k:04d}": "the same beginning of all of them " + " ".join(rng.choice("abcdefghijklmnop") * rng.randint(2, 9) for _ in range(rng.randint(1, 9))) for k in range(3000)}
    every = spark.createDataFrame([("p", i, t, i) for i, t in texts.items()], "pred string, rep string, norm string, last string")
    sized = every.select("pred", "rep", "norm").mapInArrow(nd._sizes, "pred string, rep string, norm string, size long").selectExpr("*", "1.0D AS weight")
    blocked = nd.blocks(sized, 200).cache()
    assert {r["count"] for r in blocked.groupBy("block").count().collect()} <= set(range(150, 251)) and blocked.count() == 3000
    tasks = nd.meetings(blocked, 0.7).groupBy("i", "j").count().collect()
    n_blocks = blocked.select("block").distinct().count()
    assert n_blocks >= 14 and max(r["count"] for r in tasks) <= 2 * 3000 / n_blocks * 1.2 and len(tasks) <= n_blocks * (n_blocks + 1) // 2
    assert sum(r["count"] for r in tasks) < 3000 * n_blocks


def test_groups_do_not_list_the_pairs_of_a_clique(spark):
    base = "one statement that is said again and again with hardly any difference at its end "
    every = spark.createDataFrame([("p", f"c{k:03d}", base + chr(97 + k // 26) + chr(97 + k % 26), f"c{k:03d}") for k in range(300)], "pred string, rep string, norm string, last string")
    found = nd.similar_classes(every, 0.7, 20_000, summed=True).collect()
    assert sum(r.b is not None for r in found) == 299 and {r.n_links for r in found if r.b is None} == {299}
