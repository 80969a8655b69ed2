"""Every query with SQL equals DuckDB on the smallest tables; every other one runs."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

from quillspark.plans import catalog

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

catalog.load()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, columns):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)


def test_entry_contract(spark):
    import __spark_entry__

    assert set(catalog.ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
