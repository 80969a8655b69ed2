"""document_chunks equals its SQL on texts that the small tables lack."""

from __future__ import annotations

import pytest

from quillspark.plans import catalog

ODD = [
    None,
    "",
    " ",
    "\n \n",
    "\t",
    " \t a\tb \t",
    "a\x0bb \x0b",
    "a  ",
    "a \x85",
    "a b 　 c",
    "a\r\nb\f",
    "é " * 1300,
    "\U0001f600 x" * 700,
    "word " * 400 + " " * 4000 + "end",
    " " * 5000,
    "\t" * 1600 + "x" * 300,
    "x" * 1799 + "\t" + "y" * 200,
    *("z" * n for n in (199, 200, 201, 1799, 1800, 1801, 3400, 3401)),
]


def test_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    catalog.load()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = catalog.QUERIES["document_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(catalog.ORACLE["document_chunks"])
    assert got.columns == want.columns
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
