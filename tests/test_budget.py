"""Choosing within a budget across tasks, against a plain walk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mnemoframe.operators.budget import choose

SCHEMA = "session string, doc long, n long, at long, h long, key string, item string"


def walk(rows, budget):
    out, used = set(), {}
    for s, d, n, _ in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[1])):
        if used.get(s, 0) + (n or 0) <= budget:
            used[s] = used.get(s, 0) + (n or 0)
            out.add((s, d, n or 0, used[s]))
    return out


def test_a_session_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [("hot" if k % 3 == 0 else f"s{k % 17}", k, rng.choice([0, 1, 3, 40, 90, 400, None]), rng.choice([None, *range(40)])) for k in range(1200)]
    df = spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], SCHEMA)
    for partitions in (1, 7, 40):
        got = choose(df, "session", "doc", F.col("n"), 300, F.col("at"), partitions=partitions).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == walk(rows, 300)


def test_no_task_holds_a_hot_session(spark):
    rows = [("hot" if k % 3 else f"s{k}", k, 1, k) for k in range(30_000)]
    df = spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], SCHEMA)
    by = [F.xxhash64("session"), F.col("at").desc_nulls_last(), "doc"]
    sizes = [r[1] for r in df.repartitionByRange(20, *by).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    assert choose(df, "session", "doc", F.col("n"), 50, F.col("at"), partitions=20).where("session = 'hot'").count() == 50


def test_items_of_no_size_between_tasks(spark):
    rows = [("s", k, 60 if k in (3, 90) else 0, -k) for k in range(100)]
    df = spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], SCHEMA)
    got = {tuple(r) for r in choose(df, "session", "doc", F.col("n"), 100, F.col("at"), partitions=12).collect()}
    assert got == walk(rows, 100) and len(got) == 99


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert choose(df, "session", "doc", F.col("n"), 300, F.col("at")).count() == 0
    one = spark.createDataFrame([(None, 1, 5, 1, 0, "", ""), (None, 2, 900, 2, 0, "", ""), (None, 3, 5, None, 0, "", "")], SCHEMA)
    assert sorted((r.doc, r.used) for r in choose(one, "session", "doc", F.col("n"), 300, F.col("at")).collect()) == [(1, 5), (3, 10)]
