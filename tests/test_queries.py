"""Every core query against its SQL in DuckDB; those without SQL must give rows and a stable schema."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from mnemoframe.plans import registry
from tools.compare import plain


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, folder, duck):
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    rel = duck.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_scan_is_pushed_down(spark, folder):
    plan = registry.queries()["scope_scan"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tenant_id)" in plan and "payload" not in plan


def test_flagship(spark, folder):
    assert registry.flagship(spark, folder).count() > 0
