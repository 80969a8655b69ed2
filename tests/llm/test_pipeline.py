from __future__ import annotations

import random

import pytest

from tests.llm.conftest import sentence
from tests.llm.test_duplicates import expected_components

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted():
    """Clean texts with toxic ones, near copies, a shared passage and a leaked item."""
    r = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        words = sentence(7000 + i, 60 + i % 50).split()
        if i % 10 == 0:
            words.insert(r.randrange(len(words)), r.choice(["stupid", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 10 == 0)))
    for k in range(5):  # near copies of text 1
        words = rows[1][1].split()
        words[k * 3] = f"edit{k}"
        rows.append((400 + k, " ".join(words)))
    shared, item = sentence(8000, 70), sentence(8001, 30)
    rows += [(500 + k, sentence(8100 + k, 40) + " " + shared + " " + sentence(8200 + k, 40)) for k in range(4)]
    rows += [(600, sentence(8300, 40) + " " + item + " " + sentence(8301, 40)), (601, None), (602, ""), (700, "you are a stupid moron " + sentence(8400, 50))]
    return rows, labels, shared, item


def test_stages(spark, planted, tmp_path):
    rows, labels, shared, item = planted
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == COLUMNS, name
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    quality, near, passages, clean = seen
    toxic = {i for i, _, t in labels if t}
    assert 700 not in quality and len(toxic & set(quality)) <= 1
    assert len(set(range(300)) - toxic - set(quality)) <= 3
    want = {c for i, _, c in expected_components([(i, t) for i, t in rows if i in quality])}
    assert set(near) == want and not {400, 401, 402, 403, 404} & set(near) and 1 in near
    assert set(passages) == set(near)
    assert sum(shared in t for t in passages.values() if t) == 1
    untouched = [i for i in near if i not in (500, 501, 502, 503)]
    assert all(passages[i] == near[i] for i in untouched)
    assert set(passages) - set(clean) == {600}
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(clean)
    for i in clean:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert own[0][0] == 0 and sum(n for _, n, _ in own) == own[0][2]


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_messy_rows(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, sentence(9999, 40))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        if "n_chars" in out.columns:
            out = out.select(*now.columns)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
    kept = [r["doc_id"] for r in now.collect()]
    assert {0, 1, 2, 3, 8, 16} <= set(kept) and kept.count(7) <= 1 and kept.count(4) == 1
