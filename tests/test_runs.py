"""Runs of parent keys: what they compress, and that their ends decide."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators.orphan_references import judge, match_runs, numbered, orphans, runs

KEYS = "target string, tenant_id string, ref_key string"


def known(spark, keys, erased=(), late=(), base=10):
    rows = [("s", "t", k, 50 if k in late else 1, k in erased) for k in keys]
    return numbered(spark.createDataFrame(rows, KEYS + ", arrived long, erased boolean"), base).drop("ref_key")


def asked(spark, keys, at=10):
    return numbered(spark.createDataFrame([("s", "t", k, at) for k in keys], KEYS + ", earliest long"))


def found(matched):
    return {r.ref_key: r.ok for r in matched.select("ref_key", F.coalesce(F.col("n") <= F.col("run.last"), F.lit(False)).alias("ok")).collect()}


def test_sequential_keys_become_few_runs(spark):
    keys = [f"ord-{k:07d}" for k in range(200_000) if k % 1000 != 7]
    table = runs(known(spark, keys))
    assert table.count() == 200 + 1 + 200_000 // 65_536  # gaps, and the borders of blocks
    got = found(match_runs(asked(spark, [f"ord-{k:07d}" for k in (0, 6, 7, 8, 1007, 65_535, 65_536, 199_999, 200_000)] + ["ord-0", "x", ""]), table))
    assert got == {"ord-0000000": True, "ord-0000006": True, "ord-0000007": False, "ord-0000008": True, "ord-0001007": False, "ord-0065535": True, "ord-0065536": True, "ord-0199999": True, "ord-0200000": False, "ord-0": False, "x": False, "": False}


@pytest.mark.parametrize("shift", [-1, 1])
def test_a_shifted_end_is_noticed(spark, shift):
    table = runs(known(spark, [f"k{k:03d}" for k in range(100) if k % 10 > 3]))
    refs = asked(spark, [f"k{k:03d}" for k in range(100)])
    right, wrong = found(match_runs(refs, table)), found(match_runs(refs, table.withColumn("last", F.col("last") + shift)))
    assert right == {f"k{k:03d}": k % 10 > 3 for k in range(100)} and wrong != right


def test_uuids_are_numbered_one_to_one(spark):
    keys = ["00000000-0000-0000-0000-00000000000a", "00000000-0000-0000-0000-00000000000b", "00000000-0000-0000-0001-00000000000a", "00000000-0000-0000-0000-00000000000", "a1", "a01", "a", "", "9" * 30, "8" + "9" * 29, "ß7"]
    for base in (10, 16):
        assert len({(r.block, r.n) for r in known(spark, keys, base=base).select("block", "n").collect()}) == len(keys)
    assert runs(known(spark, keys[:2], base=16)).count() == 1


def test_bounds_settle_and_members_are_looked_up(spark):
    keys = [f"m{k}" for k in range(10, 40)]
    parents = known(spark, keys, erased={"m12"}, late={"m15"})
    got = {(r.n, r.found, r.erased, r.arrived) for r in judge(asked(spark, ["m11", "m12", "m15", "m39", "m40"]), parents).collect()}
    assert got == {(12, True, True, 1), (15, True, False, 50), (40, False, None, None)}


def test_hot_parent_and_repeated_rows(spark):
    refs = spark.createDataFrame([("t", "f", f"r{k}", None, "s", "k1" if k % 3 else "k2", 5) for k in range(3000)] * 2, "table_name string, field_name string, record_id string, tenant_id string, target string, ref_key string, referred bigint")
    parents = spark.createDataFrame([(None, "k1", 9, False, "s")] * 500, "tenant_id string, ref_key string, arrived long, erased boolean, target string")
    got = orphans([refs], [parents]).groupBy("orphan_kind").count().collect()
    assert {r[0]: r[1] for r in got} == {"late": 2000, "missing": 1000}
