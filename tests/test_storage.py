from __future__ import annotations

import pyarrow.parquet as pq
from pathlib import Path

from mnemoframe.plans import records as Q


def test_every_relation_counts_with_whole_rows(spark, folder):
    got = {r.relation: r for r in Q.storage_rollup_rows(spark, folder).collect()}
    assert set(got) == {p.stem for p in Path(folder).glob("*.parquet")}
    assert all(got[p.stem].n_rows == pq.read_metadata(p).num_rows for p in Path(folder).glob("*.parquet"))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toJSON().collect()
    assert got["embeddings"].n_bytes == sum(len(r.encode()) for r in rows) and got["embeddings"].mean_bytes == round(sum(len(r.encode()) for r in rows) / len(rows), 3)
