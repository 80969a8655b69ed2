from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import term_markers
from quillspark.operators import versions as V
from quillspark.streaming.documents import ingest, latest


def test_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("word " * 600)
    run = lambda: ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"), "set").awaitTermination(60)
    assert run()
    first = latest(spark, str(tmp_path / "out"))
    assert {(r["document_id"], r["chunk_index"]) for r in first.collect()} == {("set_a", 0), ("set_a", 1)}
    (source / "b.md").write_text("short text")
    assert run() and run()
    got = {(r["document_id"], r["chunk_index"]): r["token_count"] for r in latest(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {("set_a", 0), ("set_a", 1), ("set_b", 0)} and got["set_b", 0] == 2


def test_versions(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert V.seed(spark, path) == 1 and V.seed(spark, path) == 1 and V.bump(spark, path) == 2 and V.current(spark, path) == 2


def test_heal_and_resize(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = V.healed(old, T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())]))
    assert new.columns == ["id", "title"] and new.first()["title"] is None
    with pytest.raises(ValueError):
        V.healed(old, T.StructType([T.StructField("must", T.StringType(), False)]))
    vectors = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],)], "embedding array<float>")
    assert V.resized(vectors, 2, truncate=True).first()["embedding"] == [1.0, 2.0] and V.resized(vectors, 3).count() == 1


def test_markers(spark):
    row = spark.createDataFrame([("an *Asset and (*income), not 2*3 *",)], "v string").select(term_markers(F.col("v")).alias("r")).first()
    assert row["r"] == ["asset", "income"]
