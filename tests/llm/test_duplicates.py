from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.components import components
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join
from quillspark.llm.jaccard_join import link_documents, shared_shingles, tile_links
from quillspark.llm.phrase_automata import _characters, _covered, remove_repeats
from quillspark.llm.suffix_array import repeats, without_repeats
from tests.llm.conftest import sentence


def split(t):
    return (t or "").encode().split()


def covered(texts, window):
    """Word masks of windows that also start elsewhere."""
    count = Counter(tuple(w[a : a + window]) for _, t in texts for w in [split(t)] for a in range(len(w) - window + 1))
    for i, t in texts:
        w, mask = split(t), [False] * len(split(t))
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                mask[a : a + window] = [True] * window
        yield i, w, mask


def expected_phrases(texts, window):
    out = []
    for i, w, mask in covered(texts, window):
        kept = b" ".join(x for x, c in zip(w, mask) if not c)
        out.append((-1 if i is None else i, len(w), sum(mask), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("window", [35, 12])
def test_phrases_equal_brute_force(docs, texts, window):
    assert rows(remove_repeats(docs, window=window)) == expected_phrases(texts, window)


def test_kept_text(docs, texts):
    got = remove_repeats(docs, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_phrases_on_random_small_alphabets(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(0, 30)))) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(remove_repeats(frame, window=9, gram=3)) == expected_phrases(texts, 9)


def opposites(n=10):
    """Two unlike words of 2**n letters on which polynomial hashes modulo 2**64 agree."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_unlike_words_with_one_polynomial_hash(spark):
    x, y = opposites()
    common = sentence(77, 34)
    frame = spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}"), (3, x), (4, y), (5, f"{common} {x}")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(frame).collect()} == {1: 35, 2: 0, 3: 0, 4: 0, 5: 35}
    got = {r["doc_id"]: r["component_id"] for r in link_documents(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}  # of 30 shingles of documents 1 and 2, 29 are common
    assert {r["doc_id"] for r in repeats(frame, window=35).collect()} == {1, 5}


def test_words_beyond_the_code_points():
    codes = np.array([5, 1_200_000, 3, 40_000, 5, 1_200_000, 3])
    points, width = _characters(codes)
    text = points.tobytes().decode("utf-32-le")
    assert width == 2 and len(set(points[::2].tolist()) & set(points[1::2].tolist())) == 0
    (mask,) = _covered([text], [np.array([0])], 3, width)
    assert mask.tolist() == [True, True, True, False, True, True, True]


def test_shingles_by_their_words():
    r = random.Random(1)
    for _ in range(300):
        x, y = (" ".join(r.choice(["a", "B", "b", "longer-than-eight", "Longer-than-Eight"]) for _ in range(r.randrange(1, 14))) for _ in "xy")
        sets = []
        for t in (x, y):
            w = t.lower().split()
            sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})
        shared, together = shared_shingles(x.encode(), y.encode(), 5)
        assert shared == len(sets[0] & sets[1]) and (not shared or together == len(sets[0] | sets[1]))


def test_classes_whose_names_clash(spark, docs, texts, monkeypatch):
    sound = jaccard_join._class_name
    monkeypatch.setattr(jaccard_join, "_class_name", lambda text, attempt: sound(text, attempt) if attempt > 1 else F.length(text).cast("long"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in link_documents(docs).collect())
    assert got == expected_components(texts)


def test_empty_tables(empty):
    assert remove_repeats(empty).count() == 0
    assert repeats(empty).count() == 0
    assert without_repeats(empty).count() == 0
    assert link_documents(empty).count() == 0


def test_suffix_spans_cover_what_repeats(docs, texts):
    got = {}
    for r in repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, w, mask in covered(texts, 50):
        found = [False] * len(w)
        for r in got.get(i, []):
            for p in r["passages"]:
                if p["stop"] <= len(w):
                    found[p["start"] : p["stop"]] = [True] * (p["stop"] - p["start"])
        if i not in (None, 7, 11):  # ids with several rows; a periodic text
            assert not any(f and not m for f, m in zip(found, mask))
            assert sum(f and m for f, m in zip(found, mask)) == sum(mask)
        if not any(mask):
            assert i not in got or i is None


@pytest.mark.parametrize("tail", [30, 45])
def test_passages_with_a_hot_tail(spark, tail):
    """Pairs that share 55 words, the last of which stand in many other texts too."""
    hot = sentence(20, tail)
    texts = []
    for i in range(40):
        passage = sentence(3000 + i, 55 - tail) + " " + hot
        texts += [(2 * i + j, f"{sentence(4000 + 2 * i + j, 60)} {passage} {sentence(5000 + 2 * i + j, 60)}") for j in (0, 1)]
    texts += [(1000 + i, f"{sentence(6000 + i, 60)} {hot} {sentence(7000 + i, 60)}") for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {r["doc_id"]: sum(([*range(p["start"], p["stop"])] for p in r["passages"]), []) for r in repeats(frame).collect()}
    assert found == {i: places for i, _, mask in covered(texts, 50) if (places := [k for k, m in enumerate(mask) if m])}
    kept = Counter(tuple(w[a : a + 50]) for r in without_repeats(frame).collect() for w in [split(r["text"])] for a in range(len(w) - 49))
    assert max(kept.values()) == 1


def test_one_copy_of_every_passage_stays(spark, docs, texts):
    kept = without_repeats(docs)
    assert kept.columns == docs.columns
    now = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(now) == len(texts)
    words_before, words_after = ({w for _, t in rows for w in split(t)} for rows in (texts, now))
    assert words_before == words_after  # no word is lost altogether
    assert len({t for i, t in now if i == 7}) == 1  # equal rows share a key: both keep or lose the same words
    distinct = {(i, t) for i, t in now}
    repeated = Counter(tuple(w[a : a + 50]) for _, t in distinct for w in [split(t)] for a in range(len(w) - 49))
    assert sum(n - 1 for g, n in repeated.items() if len(set(g)) > 1) == 0
    assert [t for i, t in now if i == 16] == [t for i, t in texts if i == 16]
    assert [t for i, t in now if i == 0] == [None]


def expected_components(texts, percent=80):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    key = lambda x: -1 if x is None else x
    return sorted((key(d), len(sets[i]), key(least[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(texts))


@pytest.mark.parametrize("block", [1024, 2])
def test_links_equal_brute_force(spark, docs, texts, block):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in link_documents(docs, block=block).collect())
    assert got == expected_components(texts)


def test_links_in_chains_and_large_groups(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(80)]
    texts = []
    for i in range(150):
        if i % 3 == 0:
            base[r.randrange(80)] = f"x{i}"  # neighbours are alike, the ends are not
        texts.append((i, " ".join(base if i % 2 else [*base, f"tail{i}"])))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    for block in (1024, 8):
        got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in link_documents(frame, block=block).collect())
        assert got == expected_components(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=12), st.integers(0, 5))
def test_tile_forest_has_every_link(sets, seed):
    arrays = [np.sort(np.array([(x * 0x9E3779B97F4A7C15) % 2**64 for x in s], np.uint64)) for s in sets]
    side = np.random.default_rng(seed).integers(0, 3, len(sets)) if seed else np.zeros(len(sets), int)
    links = tile_links(arrays, side, 80)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        root[find(a)] = find(b)
    for i in range(len(sets)):
        for j in range(i):
            pair = {int(side[i]), int(side[j])}
            if pair in ({0}, {0, 2}, {1, 2}) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert find(i) == find(j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
