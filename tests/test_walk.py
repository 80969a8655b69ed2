"""Walks in several blocks of nodes and terms against dense matrices."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillspark.operators import graph as G
from quillspark.operators import walk as W

N, TERMS = 22, 7


@pytest.fixture(scope="module")
def parts(spark):
    """(names, links, to_terms, uses) of a walk and its matrix; blocks of 4 make six of nodes and two of terms."""
    r = random.Random(3)
    links = {(r.randrange(N), r.randrange(N)): r.random() / 8 for _ in range(60)}
    to_terms = {(r.randrange(N), r.randrange(TERMS)): r.random() / 8 for _ in range(40)}
    uses = {(r.randrange(N), r.randrange(TERMS)): r.random() / 8 for _ in range(40)}
    m, one, two = np.zeros((N, N)), np.zeros((N, TERMS)), np.zeros((TERMS, N))
    for (a, b), p in links.items():
        m[a, b] = p
    for (a, t), p in to_terms.items():
        one[a, t] = p
    for (b, t), w in uses.items():
        two[t, b] = w
    frame = lambda d, schema: spark.createDataFrame([(*k, v) for k, v in d.items()], schema)
    names = spark.createDataFrame([(f"n{i:02d}", i) for i in range(N)], "id string, g long")
    return names, frame(links, "a long, b long, p double"), frame(to_terms, "a long, t int, p double"), frame(uses, "b long, t int, w double"), m + one @ two


def test_settled_masses_in_blocks(parts):
    *walk, m = parts
    got = {r["id"]: r["x"] for r in W.Walk(*walk, block=4).settled(0.5, 7, 0.0, every=3).collect()}
    x = np.full(N, 1 / N)
    for _ in range(7):
        x = 0.5 / N + 0.5 * x @ m
    assert [got[f"n{i:02d}"] for i in range(N)] == pytest.approx(x.tolist())


def test_pagerank_in_blocks(spark, monkeypatch):
    """Dangling mass reaches every block, and an edge to a node that isn't there takes its share along."""
    monkeypatch.setattr(W, "SMALLEST", 2)
    monkeypatch.setattr(W, "BLOCKS", 3)
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "a"), ("e", "gone"), ("e", "f")]
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "id string")
    got = {r["id"]: r["rank"] for r in G.pagerank(nodes, spark.createDataFrame(pairs, "src string, dst string"), rounds=6, tolerance=0.0).collect()}
    x = np.full(7, 1 / 7)
    for _ in range(6):
        new = np.full(7, 0.15 / 7 + 0.85 * x[[2, 5, 6]].sum() / 7)
        for a, b in pairs:
            if b != "gone":
                new["abcdefg".index(b)] += 0.85 * x["abcdefg".index(a)] / sum(p[0] == a for p in pairs)
        x = new
    assert [got[n] for n in "abcdefg"] == pytest.approx(x.tolist())


@pytest.mark.parametrize("rounds", [0, 1, 2, 3, 40])
def test_pagerank_without_cycles_is_a_sum_over_paths(spark, monkeypatch, rounds):
    """No walk: as many steps as the longest path has edges, whatever the rounds; repeated edges count each."""
    monkeypatch.setattr(G, "Walk", None)
    pairs = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("e", "gone"), ("e", "d"), ("stranger", "a")]
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "id string")
    got = {r["id"]: r["rank"] for r in G.pagerank(nodes, spark.createDataFrame(pairs, "src string, dst string"), rounds=rounds).collect()}
    x = np.full(7, 1 / 7)
    for _ in range(rounds):
        new = np.full(7, 0.15 / 7 + 0.85 * x[[3, 5, 6]].sum() / 7)
        for a, b in pairs:
            if a != "stranger" and b != "gone":
                new["abcdefg".index(b)] += 0.85 * x["abcdefg".index(a)] / sum(p[0] == a for p in pairs)
        x = new
    assert [got[n] for n in "abcdefg"] == pytest.approx(x.tolist(), rel=1e-12)


@pytest.mark.parametrize("depth", [1, 8])
def test_pagerank_on_cycles_is_walked(spark, monkeypatch, depth):
    monkeypatch.setattr(G, "DEPTH", depth)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a")]
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "id string")
    got = {r["id"]: r["rank"] for r in G.pagerank(nodes, spark.createDataFrame(pairs, "src string, dst string"), rounds=12, tolerance=0.0).collect()}
    x = np.full(5, 1 / 5)
    for _ in range(12):
        new = np.full(5, 0.15 / 5 + 0.85 * x[3] / 5)
        for a, b in pairs:
            new["abcde".index(b)] += 0.85 * x["abcde".index(a)] / sum(p[0] == a for p in pairs)
        x = new
    assert [got[n] for n in "abcde"] == pytest.approx(x.tolist())


def test_more_seeds_than_walk_together(spark, parts, monkeypatch):
    monkeypatch.setattr(W, "COLUMNS", 2)
    *walk, m = parts
    own = [("p", 3, 1.0), ("q", 4, 0.25), ("q", 21, 0.75), ("r", 0, 1.0)]
    seeds = spark.createDataFrame([(s, f"n{i:02d}", w) for s, i, w in own], "seed string, id string, w double")
    got = {(r["seed"], r["id"]): r["mass"] for r in W.Walk(*walk, block=4).diffused(seeds, 0.5, 4, every=3).collect()}
    for s in "pqr":
        x = np.zeros(N)
        for t, i, w in own:
            x[i] += w * (t == s)
        want = 0.5 * x
        for k in range(4):
            x = 0.5 * x @ m
            want = want + (1.0 if k == 3 else 0.5) * x
        assert [got.get((s, f"n{i:02d}"), 0.0) for i in range(N)] == pytest.approx(want.tolist())
        assert {i for t, i in got if t == s} == {f"n{i:02d}" for i in np.flatnonzero(want)}
