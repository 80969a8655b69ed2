from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.hard_negatives import Quantiser, mine, usable

KIND = "vec_id bigint, embedding array<float>, label int, row string, codes string, extra int"


def brute(rows):
    """The definition over plain lists; rows are (vec_id, embedding, label)."""
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(good):
        if i is None or i % 10:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=True)), j, m) for n, (j, w, m) in enumerate(good) if n != k]
        near = sorted((s for s in scores if s[2] == label), key=order)[:5]
        for p, pid, _ in near:
            inside = sorted((s for s in scores if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:10]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out, key=str)


def vectors(n, d, labels, seed):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=d) / math.sqrt(d)).astype(np.float32).tolist(), int(r.integers(labels))) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], KIND).repartition(3)
    return sorted((tuple(r) for r in mine(df, F.col("vec_id") % 10 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"block": 7, "sub_dim": 4, "centroids": 8, "sample": 50}), (3, {"sub_dim": 16, "centroids": 2})])
def test_equals_brute_force(spark, seed, more):
    rows = vectors(400, 16, 4, seed)
    assert run(spark, rows, **more) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(120, 8, 2, 4)
    same = rows[20][1]
    rows += [(200 + i, same, i % 2) for i in range(60)]  # ties
    rows += [(None, same, 0), (None, rows[3][1], 1), (301, None, 1), (302, same, None), (303, [math.nan] + same[1:], 0), (304, [math.inf] + same[1:], 0), (305, [None] + same[1:], 1), (306, [0.0] * 8, 0), (310, [0.0] * 8, 1), (320, [1000.0] * 8, 1), (330, [-3.0] * 8, 0)]
    rows += [(340, same, 5)]  # no positive
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = vectors(60, 8, 2, 5)
    rows += [rows[10], rows[11]]
    assert run(spark, rows) == brute(rows)


def test_bounds_hold():
    r = np.random.default_rng(7)
    x, q = r.integers(-400, 400, (500, 12)), None
    q = Quantiser.fit(x[:80], 3, 16)
    codes, norms = q.encode(x)
    low, high = q.bounds(x[:40].astype(float), codes, norms)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < np.abs(exact).max()


def test_empty_and_other_lengths(spark):
    none = spark.createDataFrame([], KIND)
    assert mine(none, F.col("vec_id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0], 1), (4, [2e6, 1.0], 1), (5, [], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(r["vec_id"] for r in usable(df).collect()) == [1, 2]
