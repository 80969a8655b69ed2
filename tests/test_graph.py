from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.operators import hierarchy as H
from quillspark.operators import search as S
from quillspark.operators import tables as T
from quillspark.operators import vectors as V
from quillspark.operators.push import push_tops


@pytest.fixture(scope="module")
def world(spark):
    """A small corpus of a tree, citations and terms, and its transition matrix by the definition."""
    r = random.Random(1)
    nodes = [f"n{i:02d}" for i in range(30)] + ["alone"]
    parent = {n: (None if i == 0 else nodes[r.randrange(i)]) for i, n in enumerate(nodes[:30])} | {"alone": "elsewhere"}
    cited = [(r.choice(nodes[:30]), r.choice(nodes[:30])) for _ in range(40)] + [("n01", None)]
    used = [(r.choice(nodes[:30]), r.choice(["Tax ", "tax", "income", "rare"])) for _ in range(50)]
    p = spark.createDataFrame([(n, parent[n], i) for i, n in enumerate(nodes)], "internal_id string, parent_internal_id string, sibling_order int")
    refs = spark.createDataFrame([(a, b) for a, b in cited], "source_internal_id string, target_internal_id string")
    terms = spark.createDataFrame(used, "source_internal_id string, term_text string")
    at, m = {n: i for i, n in enumerate(nodes)}, np.zeros((31, 31))
    for a, b in cited:
        if b and a != b:
            m[at[a], at[b]] += 0.45
    for n, up in parent.items():
        if up in at:
            m[at[n], at[up]] += 0.2
            m[at[up], at[n]] += 0.2
    for up in {x for x in parent.values()}:
        kids = [n for n in nodes if parent[n] == up]
        for a, b in zip(kids, kids[1:]):
            m[at[a], at[b]] += 0.16
            m[at[b], at[a]] += 0.16
    users = {}
    for n, t in used:
        users.setdefault(t.strip().lower(), set()).add(n)
    for own in users.values():
        for a in own:
            for b in own - {a}:
                m[at[a], at[b]] += 0.2 * max(0.2, min(2.0, 1 / np.log(1 + len(own))))
    for i in range(31):
        if not m[i].sum():
            m[i, i] = 1
    return nodes, m / m.sum(1, keepdims=True), G.Mixed.of(p, refs, terms), (p, refs, terms)


def test_power_iteration(world):
    nodes, m, graph, _ = world
    got = {r["id"]: r["pi"] for r in G.power_iteration(graph, 0.5, 50).collect()}
    pi = np.full(31, 1 / 31)
    for _ in range(50):
        pi = 0.5 / 31 + 0.5 * pi @ m
    assert [got[n] for n in nodes] == pytest.approx((pi / pi.sum()).tolist())
    sums = {r["src"]: r["p"] for r in graph.rows().groupBy("src").agg({"p": "sum"}).withColumnRenamed("sum(p)", "p").collect()}
    assert set(sums) == set(nodes) and all(v == pytest.approx(1) for v in sums.values())


def pushed_by_hand(m: np.ndarray, weights: dict[int, float], gamma: float, eps: float) -> np.ndarray:
    """A queue over a dense matrix, first in, first out; neighbours in the order of their numbers."""
    rest, mass, queue = np.zeros(len(m)), np.zeros(len(m)), sorted(weights)
    for s, w in weights.items():
        rest[s] = w
    while queue:
        u = queue.pop(0)
        if rest[u] < eps:
            continue
        value, rest[u] = rest[u], 0.0
        mass[u] += (1 - gamma) * value
        for v in np.flatnonzero(m[u]):
            got = gamma * value * m[u, v]
            if got < eps:
                continue
            before = rest[v]
            rest[v] = before + got
            if before < eps <= rest[v]:
                queue.append(v)
    return mass


@pytest.mark.parametrize("eps", [1e-6, 0.01])
@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_push_equals_a_queue_over_the_matrix(spark, world, eps, limit):
    nodes, m, graph, _ = world
    own = {"a": {"n00": 1.0}, "b": {"n07": 1.0}, "c": {"alone": 1.0}, "d": {"n03": 0.5, "n20": 0.3, "n01": 0.2}} | {n: {n: 1.0} for n in nodes[10:16]}
    seeds = spark.createDataFrame([(s, n, w) for s, ws in own.items() for n, w in ws.items()], "seed string, id string, w double")
    for top in (200, 5) if limit else (5,):
        rows = push_tops(seeds, graph.push_graph(), 0.5, eps, top, limit=limit, block=3).collect()
        assert {r["seed"] for r in rows} == set(own)
        for s, ws in own.items():
            want = pushed_by_hand(m, {nodes.index(n): w for n, w in ws.items()}, 0.5, eps)
            best = sorted((i for i in range(31) if want[i] > 0), key=lambda i: (-round(want[i], 12), i))[:top]
            got = sorted((r for r in rows if r["seed"] == s), key=lambda r: r["r"])
            assert [r["id"] for r in got] == [nodes[i] for i in best] and [r["r"] for r in got] == list(range(1, len(best) + 1))
            assert [r["mass"] for r in got] == pytest.approx([want[i] for i in best]) and got[0]["captured"] == pytest.approx(sum(want[i] for i in best))


def test_a_share_in_several_terms_counts_as_one(spark):
    """Three terms in common give one neighbour a joint share above eps, though no term does alone."""
    p = spark.createDataFrame([("a", None, 0), ("b", "x", 1), ("c", "y", 2)], "internal_id string, parent_internal_id string, sibling_order int")
    refs = spark.createDataFrame([], "source_internal_id string, target_internal_id string")
    terms = spark.createDataFrame([(n, t) for t in ("one", "two", "three") for n in ("a", "b")], "source_internal_id string, term_text string")
    graph = G.Mixed.of(p, refs, terms)
    seeds = spark.createDataFrame([("a", "a", 1.0)], "seed string, id string, w double")
    got = {r["id"]: r["mass"] for r in G.push_masses(seeds, graph, 0.5, 0.2).collect()}
    assert got == pytest.approx({"a": 0.625, "b": 0.25})  # a third of the share, 0.167, would be dropped


def test_rows_sum_to_one_with_users_that_are_no_nodes(spark):
    p = spark.createDataFrame([(n, None, i) for i, n in enumerate("abc")], "internal_id string, parent_internal_id string, sibling_order int")
    refs = spark.createDataFrame([("a", "b"), ("a", "gone")], "source_internal_id string, target_internal_id string")
    terms = spark.createDataFrame([("a", "tax"), ("b", "tax"), ("c", "tax"), ("foreign", "tax"), ("foreign", "levy"), ("c", "levy")], "source_internal_id string, term_text string")
    graph = G.Mixed.of(p, refs, terms)
    sums = {}
    for r in graph.rows().collect():
        sums[r["src"]] = sums.get(r["src"], 0.0) + r["p"]
    assert sums == pytest.approx({"a": 1.0, "b": 1.0, "c": 1.0})
    walk = G.Walk.of(graph)
    assert walk.step(graph.nodes.selectExpr("id", "1D AS x")).agg({"x": "sum"}).first()[0] == pytest.approx(3.0)
    walk.close()
    assert sum(r["pi"] for r in G.power_iteration(graph, 0.5).collect()) == pytest.approx(1.0)


def test_diffusion_equals_the_matrix(spark, world):
    nodes, m, graph, _ = world
    seeds = spark.createDataFrame([("q", "n03", 0.25), ("q", "n04", 0.75)], "seed string, id string, w double")
    got = {r["id"]: r["mass"] for r in G.diffuse(seeds, graph, 0.55, 6).collect()}
    x = np.zeros(31)
    x[3], x[4] = 0.25, 0.75
    want = 0.45 * x
    for k in range(6):
        x = 0.55 * x @ m
        want = want + (1.0 if k == 5 else 0.45) * x
    assert [got.get(n, 0.0) for n in nodes] == pytest.approx(want.tolist())


def test_stored_fingerprints_are_read_and_others_pushed(spark, world):
    _, _, graph, (p, refs, terms) = world
    stored = spark.createDataFrame([("n00", "n05", 0.5)], "seed string, id string, mass double")
    seeds = spark.createDataFrame([("n00",), ("n01",)], "seed string")
    got = G.stored_or_pushed(seeds, stored, graph).collect()
    assert [(r["id"], r["mass"]) for r in got if r["seed"] == "n00"] == [("n05", 0.5)] and sum(r["seed"] == "n01" for r in got) > 3


def local_by_hand(seeds, parent, order, cited, used, near=()):
    """The typed edges around seeds, a list as they are met, and the nodes."""
    nodes, edges, front = set(seeds), [], set(seeds)
    for _ in range(2):
        ends = set()
        for a, b in cited:
            if b and (a in front or b in front):
                edges.append((a, b, 0.45))
                ends |= {a, b}
        nodes |= ends
        front = ends - front
    kids = {}
    for n in order:
        kids.setdefault(parent[n], []).append(n)
    ups = set()
    for n in list(nodes):
        if parent.get(n):
            ups.add(parent[n])
            edges += [(n, parent[n], 0.2), (parent[n], n, 0.2)]
    nodes |= ups
    for up in ups:
        for n in kids.get(up, []):
            edges += [(n, up, 0.2), (up, n, 0.2)]
            nodes.add(n)
        for a, b in zip(kids.get(up, []), kids.get(up, [])[1:]):
            edges += [(a, b, 0.2), (b, a, 0.2)]
    for t in {t for n, t in used if n in seeds}:
        own = sorted({n for n, u in used if u == t})
        nodes |= set(own)
        edges += [(a, b, 0.2) for a in own[:200] for b in own[:200] if a != b]
    for a, b in near:
        edges += [(a, b, 0.05), (b, a, 0.05)]
        nodes.add(b)
    return nodes, edges


def test_local_graph_and_joint_push_by_hand(spark):
    r = random.Random(4)
    ids = [f"A_{i:02d}" for i in range(40)]
    parent = {n: (None if i < 2 else ids[r.randrange(i)] if i < 30 else "A_root_elsewhere") for i, n in enumerate(ids)}
    cited = [(r.choice(ids), r.choice(ids)) for _ in range(45)] + [("A_01", None), ("B_1", "A_02"), ("A_02", "B_1")]
    used = sorted({(r.choice(ids), r.choice(["Tax", "tax", "rare"])) for _ in range(30)})
    near = [("A_05", "A_33", 1), ("A_05", "A_34", 2), ("A_05", "B_1", 3)]
    p = spark.createDataFrame([(n, parent[n], i) for i, n in enumerate(ids)], "internal_id string, parent_internal_id string, sibling_order int")
    refs = spark.createDataFrame(cited, "source_internal_id string, target_internal_id string")
    terms = spark.createDataFrame(used + [("B_1", "tax")], "source_internal_id string, term_text string")
    groups = {"one": {"A_05": 1.0}, "all": {"A_05": 3.0, "A_11": 1.0, "A_20": 1.0, "A_07": 2.0}}
    seeds = spark.createDataFrame([(g, i, w) for g, ws in groups.items() for i, w in ws.items()], "grp string, id string, w double")
    local = G.local_graph(seeds, p, refs, terms, spark.createDataFrame(near, "id string, other string, r int"), "A")
    got = {}
    for e in local.edges.collect():
        got.setdefault(e["grp"], {})[e["src"], e["dst"]] = e["w"]
    found = {}
    for e in G.local_fingerprints(seeds, local).collect():
        found.setdefault(e["grp"], {})[e["id"]] = e["mass"]
    inside = [(a, b) for a, b in cited if b and a[0] == b[0] == "A"]
    up = {n: u if u and u.startswith("A_") else None for n, u in parent.items()}
    for g, ws in groups.items():
        nodes, edges = local_by_hand(set(ws), up, ids, inside, used, [(a, b) for a, b, _ in near if b[0] == "A"])
        want = {}
        for a, b, w in edges:
            want[a, b] = want.get((a, b), 0.0) + w
        assert got[g] == pytest.approx(want)
        names = sorted(nodes)
        assert sorted(n["id"] for n in local.nodes.where(F.col("grp") == g).collect()) == names
        m = np.zeros((len(names), len(names)))
        for (a, b), w in want.items():
            m[names.index(a), names.index(b)] = w
        for i in range(len(names)):
            if not m[i].sum():
                m[i, i] = 1.0
        m /= m.sum(1, keepdims=True)
        total = sum(ws.values())
        mass = pushed_by_hand(m, {names.index(i): w / total for i, w in ws.items()}, 0.55, 1e-6)
        assert found[g] == pytest.approx({n: mass[i] for i, n in enumerate(names) if mass[i] > 0 and n not in ws})


def test_read_through_cache_by_version(spark, world, tmp_path):
    _, _, graph, (p, refs, terms) = world
    cache = T.Fingerprints(spark, str(tmp_path / "prints"))
    named = lambda df, *cs: df.withColumns({c: F.concat(F.lit("A_"), c) for c in cs})
    around = S.Around(named(p, "internal_id", "parent_internal_id"), named(refs, "source_internal_id", "target_internal_id"), named(terms, "source_internal_id"), cache=cache, version=1)
    few = spark.createDataFrame([("A", "A_n01", 0.5), ("A", "A_n02", 0.5)], "act_id string, id string, w double")
    first = {r["id"]: r["mass"] for r in S.read_through(few, cache.at(1), around).collect()}
    assert {r["seed"] for r in cache.at(1).select("seed").distinct().collect()} == {"A_n01", "A_n02"}  # misses are written
    again = {r["id"]: r["mass"] for r in S.read_through(few, cache.at(1), around).collect()}
    assert again == pytest.approx(first) and first["A_n01"] >= 0.025
    assert cache.at(2).count() == 0  # a bump of the version misses
    many = spark.createDataFrame([("A", f"A_n0{i}", 0.25) for i in (3, 4, 5, 6)], "act_id string, id string, w double")
    S.read_through(many, cache.at(2), S.Around(around.p, around.refs, around.terms, cache=cache, version=2)).count()
    assert cache.at(2).count() == 0  # seeds that are pushed together are not stored
    cache.add(spark.createDataFrame([("A_n01", "A_n02", 0.5)], "seed string, id string, mass double"), 2)
    hit = {r["id"]: r["mass"] for r in S.read_through(few.where("id = 'A_n01'"), cache.at(2), around).collect()}
    assert hit == pytest.approx({"A_n02": 0.25, "A_n01": 0.025})
    cache.forget(2)
    assert cache.at(1).count() == 0 and cache.at(2).count() == 1


def test_published_tables_follow_the_data(spark, tmp_path):
    from quillspark.plans.graph_queries import published

    spark.range(3).write.parquet(str(tmp_path / "orders.parquet"))
    count = lambda: published(spark, str(tmp_path), "n", lambda: spark.read.parquet(str(tmp_path / "orders.parquet")).count())
    assert count() == 3 and count() == 3
    spark.range(2).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert count() == 5


def test_pagerank_spreads_dangling_mass(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {r["id"]: r["rank"] for r in G.pagerank(nodes, edges, rounds=60).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["c"] > got["b"] > got["a"]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a", "a"), ("x", "x")], "root string, id string")
    got = {(r["root"], r["id"]) for r in G.closure(start, edges).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}


def test_siblings_and_breadcrumbs(spark):
    p = spark.createDataFrame([("r", None, 0, "R", "root"), ("r_b", "r", 1, "R.b", "bee"), ("r_a", "r", None, "R.a", "ay"), ("r_c", "r", 0, "R.c", "sea")], "internal_id string, parent_internal_id string, sibling_order int, path string, title string")
    assert [tuple(r) for r in G.adjacent_siblings(p).orderBy("a").collect()] == [("r_b", "r_a"), ("r_c", "r_b")]
    got = {r["internal_id"]: r["trail"] for r in H.breadcrumbs(p, p).collect()}
    assert got == {"r": "root", "r_b": "root > bee", "r_a": "root > ay", "r_c": "root > sea"}
    assert [r["internal_id"] for r in p.orderBy(*H.sibling_sort()).collect()] == ["r", "r_c", "r_b", "r_a"]


def test_term_pairs_are_capped_by_id(spark):
    terms = spark.createDataFrame([(f"s{i:03d}", "Tax ") for i in range(30)] + [("s000", "rare"), ("s001", "rare")], "source_internal_id string, term_text string")
    got = {(r["a"], r["b"]): r["terms"] for r in G.term_cooccurrence(terms, per_term=10).collect()}
    assert len(got) == 45 and got["s000", "s001"] == 2
    links = {r["id"]: (r["terms"], r["links"]) for r in G.term_links(terms).collect()}
    assert links["s000"] == (2, 30) and links["s029"] == (1, 29)


def test_a_long_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(40)], "src string, dst string")
    assert G.closure(spark.createDataFrame([("r", "0")], "root string, id string"), edges).count() == 41


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.random((40, 8)).astype("float32")
    base = spark.createDataFrame([(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = V.nearest(base.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS q"), base.select("vec_id", "embedding"), 5).collect()
    for q in range(3):
        d = np.linalg.norm(x.astype(float) - x[q].astype(float), axis=1)
        d[q] = np.inf
        assert [n["vec_id"] for n in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == np.argsort(d)[:5].tolist()
    mean = V.mean_vectors(base, "label").collect()
    for label in range(3):
        assert sum(m["value"] ** 2 for m in mean if m["label"] == label) == pytest.approx(1, abs=1e-5)


def test_nearest_of_many_equal_far_and_missing_vectors(spark, monkeypatch):
    """Chunks smaller than a task's rows, ties by id, vectors without a distance last; only each task's best are shuffled."""
    monkeypatch.setattr(V, "CHUNK", 7)
    r = np.random.default_rng(5)
    x = np.concatenate([np.repeat(r.random((1, 6)), 60, 0), r.random((60, 6)) + 1e4, r.random((60, 6))]).astype("float32")
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (501, [float("nan")] * 6), (None, [0.0] * 6)]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = V.nearest(base.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), base, 10)
    got = found.collect()
    for q in range(0, 180, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(180), d)) if i != q][:10]
        own = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        assert [g["vec_id"] for g in own] == order and [g["distance"] for g in own] == pytest.approx(d[order].tolist(), abs=1e-9)
    few = V.nearest(base.where("vec_id = 1").selectExpr("vec_id AS query_id", "embedding AS q"), base.where("vec_id in (0, 500, 501)"), 10).collect()
    assert sorted((g["rank"], g["vec_id"], g["distance"]) for g in few)[0] == (1, 0, 0.0) and [g["distance"] for g in few].count(None) == 2
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_blend_and_merge(spark):
    mass = spark.createDataFrame([("A", "a", 0.5), ("A", "b", 0.3), ("A", "c", 0.2), ("B", "a", 7.0)], "act_id string, id string, mass double")
    lex = spark.createDataFrame([("A", "b", 0.9), ("A", "z", 1.0)], "act_id string, id string, score double")
    pi = spark.createDataFrame([("a", 0.1), ("b", 0.1)], "id string, pi double")
    got = {(r["act_id"], r["id"]): r for r in S.blend(mass, lex, pi).collect()}
    assert set(got) == {("A", "a"), ("A", "b"), ("A", "c"), ("B", "a")} and got["A", "c"]["urs"] == 100 and got["B", "a"]["urs"] == 50
    both = spark.createDataFrame([("R1", "x", 0.5, 80), ("R2", "x", 0.9, 90), ("R1", "y", 0.1, 10)], "act_id string, id string, score double, urs int")
    assert {(r["id"], r["act_id"], r["urs"]) for r in S.merged(both, 5).collect()} == {("x", "R2", 90), ("y", "R1", 10)}
    assert {(r["id"], r["act_id"]) for r in S.merged(both, 1).collect()} == {("x", "R2")}
    pages = [S.page(both, 2, o).collect() for o in (0, 2)]
    assert [(r["id"], r["total"], r["next_offset"]) for p in pages for r in p] == [("x", 3, 2), ("x", 3, 2), ("y", 3, None)]


def test_lexical_filter(spark):
    columns = "act_id string, id int, title string, content string"
    docs = spark.createDataFrame([("A", 1, "income tax", "ordinary income"), ("A", 2, "other", "nothing here"), ("A", 3, "incom", "z"), ("B", 4, "ordinary", "incomes of all kinds"), ("B", 5, None, None)], columns)
    found = {r["id"]: r for r in S.lexical(docs, "ordinary income").collect()}
    assert set(found) >= {1, 4} and 2 not in found and 5 not in found
    assert found[1]["ts_score"] == pytest.approx(0.15) and found[4]["ts_score"] == pytest.approx(0.1)  # stems make the plural a hit
    only_trigram = spark.createDataFrame([("A", 9, "ordinray incmoe", "")], columns)
    row = S.lexical(only_trigram, "ordinary income").first()
    assert row is None or (row["ts_score"] == 0 and row["score"] == pytest.approx(0.3 * row["tri_score"]))
    kept = S.lexical(docs, "ordinary income")
    assert S.holding_terms(kept, docs, "zz").count() == len(found) and S.holding_terms(kept, docs, "tax").count() == 1


def test_interpretation(spark):
    p = spark.createDataFrame(
        [("A_6_5", "A", "A:Section:6-5", "Section", "6-5", "Ordinary income"), ("A_D7", "A", "A:Division:7", "Division", "7", "Seven"), ("A_def", "A", "A:Definition:car", "Definition", "car", "Car"), ("B_1", "BC", "BC:Section:1", "Section", "1", "x")],
        "internal_id string, act_id string, ref_id string, type string, local_id string, title string",
    )

    def f(query):
        m = S.interpret(p, query, "A", ["A", "BC"])
        return m.provisions, m.definitions, m.keywords

    assert f("s 6-5 ordinary income")[0] == ["A_6_5"]
    assert f("what of div 7") == (["A_D7"], [], "what of")
    assert f("car; something") == ([], ["A_def"], "; something")
    assert f("BC:Section: 1 now") == (["B_1"], [], "now")
    assert f("nothing") == ([], [], "nothing") and f("  ") == ([], [], "")


def test_unified_excludes_and_takes_exact_seeds(spark, world):
    nodes, _, graph, (p, _, _) = world
    docs = spark.createDataFrame([("A", n, f"title {n}", "some words " + ("special" if n in ("n03", "n04") else "")) for n in nodes], "act_id string, id string, title string, content string")
    pi = G.power_iteration(graph, 0.5)
    free = {r["id"] for r in S.unified(docs, graph, pi, "special").collect()}
    assert {"n03", "n04"} <= free
    gone = spark.createDataFrame([("n03",)], "id string")
    assert "n03" not in {r["id"] for r in S.unified(docs, graph, pi, "special", excluded=gone).collect()}
    exact = spark.createDataFrame([("A", "n10")], "act_id string, id string")
    assert "n10" in {r["id"] for r in S.unified(docs, graph, pi, "special", exact=exact).collect()}
    assert S.unified(docs, graph, pi, "zzzz").count() == 0


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, T.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    rows = old.withColumnRenamed("v", "act_id")
    T.publish(rows, str(tmp_path / "t"), 1)
    T.publish(rows.where("id = 1"), str(tmp_path / "t"), 2)
    T.publish(rows, str(tmp_path / "t"), 1)  # a rerun takes the place of the first
    assert T.purge(old, new, "id").count() == 1
    assert T.at_version(spark, str(tmp_path / "t"), 1).count() == 2 and T.at_version(spark, str(tmp_path / "t"), 2).count() == 1


def test_pushed_masses_are_not_shuffled(spark, world):
    """Ranks, sums and names come from the task that pushed a seed; ties go by name; both ways say the same."""
    _, _, graph, _ = world
    seeds = graph.nodes.selectExpr("id AS seed", "id", "1D AS w")
    rows = push_tops(seeds, graph.push_graph(), 0.5, 1e-6, 5)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    other = push_tops(seeds, graph.push_graph(), 0.5, 1e-6, 5, limit=0)
    key = lambda df: sorted((r["seed"], r["r"], r["id"], round(r["mass"], 12), round(r["captured"], 12)) for r in df.collect())
    assert key(rows) == key(other) and len({r["seed"] for r in rows.collect()}) == 31


def test_line_items_are_dealt_once(spark):
    """Terms: by order, and grouped there; references: by order; suppliers come to the lines."""
    from quillspark.sources import model

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # orders, but not suppliers, are too many here
    try:
        for name, column in (("references", "l_orderkey"), ("term_usage", "l_orderkey")):
            plan = getattr(model, name)(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
            dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
            assert not [d for d in dealt if d.startswith(("l_suppkey", "source_internal_id"))]
            assert sum(d.startswith(column) for d in dealt) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_closure_makes_its_edges_once(spark):
    """Whatever the number of rounds: the edges may be costly joins."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "src string, dst string").mapInArrow(count, "src string, dst string")
    got = G.closure(spark.createDataFrame([("a", "a"), ("x", "x")], "root string, id string"), edges)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("x", "x")]
    assert made.value == 4
