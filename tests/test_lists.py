from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators.ivf import Lists

SF = "/root/testdata/sf0.01"


def recall(spark, base, x, ids, k=10, **more):
    lists = Lists.build(base, **more)
    asked = [int(i) for i in ids if i % 50 == 0]
    got = {}
    for r in lists.nearest(base.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    hits = total = 0
    at = {int(v): n for n, v in enumerate(ids)}
    for q in asked:
        d = np.linalg.norm(x - x[at[q]], axis=1)
        d[at[q]] = np.inf
        want = set(ids[np.argsort(d, kind="stable")[:k]].tolist())
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and all(r[2] == pytest.approx(d[at[r[1]]], abs=1e-5) for r in rows)
        hits += len(want & {r[1] for r in rows})
        total += k
    return hits / total, lists


def test_recall_on_the_given_vectors(spark):
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = base.select("vec_id", "embedding").toPandas()
    share, lists = recall(spark, base, np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy())
    assert share >= 0.9 and 1 <= lists.probes <= len(lists.centroids)


def test_clustered_vectors_need_few_lists(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 2000)] * 4 + r.normal(size=(2000, 16)) * 0.3).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (5000, None)], "vec_id bigint, embedding array<float>").repartition(4)
    share, lists = recall(spark, base, x.astype(float), np.arange(2000), lists=40)
    assert share >= 0.95 and lists.probes <= 4
    plan = lists.nearest(base.where("vec_id = 0").selectExpr("vec_id AS query_id", "embedding AS q"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "(list#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_small_bases(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    ask = one.selectExpr("vec_id + 1 AS query_id", "embedding AS q")
    assert Lists.build(none).nearest(ask, 3).count() == 0
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in Lists.build(one).nearest(ask, 3).collect()] == [(2, 1, 1)]
