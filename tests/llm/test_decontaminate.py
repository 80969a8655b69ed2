from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.decontaminate import Items, decontaminated, edit_search, leaks, normalise, propose, settlers
from tests.llm.conftest import sentence


def distance_to_substring(p: bytes, t: bytes) -> int:
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=12).map(lambda b: bytes(x % 3 for x in b)), st.binary(max_size=20).map(lambda b: bytes(x % 3 for x in b)))
def test_edit_search_is_exact(p, t):
    assert edit_search(p, t)[0] == distance_to_substring(p, t)


def edited(r: random.Random, s: bytes, n: int) -> bytes:
    out = bytearray(s)
    for _ in range(n):
        at, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[at] = r.choice(b"abcdefgh ")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, r.choice(b"abcdefgh "))
    return bytes(out)


@pytest.mark.parametrize(("share", "recall"), [(0.05, 0.99), (0.15, 0.97), (0.2, 0.9)])
def test_target_recall(share, recall):
    r = random.Random(4)
    texts = [normalise(*(lambda b: (b, np.array([0, len(b)])))(np.frombuffer(sentence(900 + i, 18 + i % 30).encode(), np.uint8)))[0].tobytes() for i in range(150)]
    items = Items.of(texts, 0.2)
    windows = [edited(r, t, int(share * len(t))) for t in texts]
    around = [b"some words before " + w + b" and some after it" for w in windows]
    data, offsets = np.frombuffer(b"".join(around), np.uint8), np.cumsum([0, *map(len, around)])
    found = {}
    for d, i, s in propose(items, data, offsets).tolist():
        if d == i:
            found[d] = data[max(s, offsets[d]) : s + len(texts[i])].tobytes()
    hit = items.lsh(list(found.values()), np.array(list(found)))
    assert hit.sum() / len(texts) >= recall


def test_leaks(spark, docs, texts):
    passage = sentence(2, 60)
    r = random.Random(8)
    bench = spark.createDataFrame([(1, "  " + passage.upper()), (2, edited(r, passage.encode(), 20).decode("utf-8", "replace")), (3, sentence(5000, 30)), (4, None), (5, ""), (6, "short"), (None, passage)], "item_id bigint, text string")
    got = leaks(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(d, i) for d in (8, 9, 10) for i in (1, 2, None)}
    assert all(x["edits"] == 0 for x in got if x["item_id"] is None) and all(0 < x["edits"] <= 60 for x in got if x["item_id"] == 2)
    small = leaks(docs, bench, block_bytes=100)
    assert sorted(map(str, small.collect())) == sorted(map(str, got))
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3


def spread(s: str, kind: str) -> str:
    """Evenly spread edits, at most one in five bytes."""
    if kind == "every 12":
        return "".join("#" if i % 12 == 11 else c for i, c in enumerate(s))
    if kind == "every 5":
        return "".join("#" if i % 5 == 4 else c for i, c in enumerate(s))
    if kind == "hyphens":
        return s.replace(" ", "-")
    if kind == "dropped":
        return "".join(c for i, c in enumerate(s) if i % 6 != 5)
    return " ".join(w[:1] + "#" + w[2:] if len(w) > 1 else w for w in s.split())


@pytest.mark.parametrize("kind", ["every 12", "every 5", "hyphens", "dropped", "letter a word"])
def test_spread_edits_are_found(spark, kind):
    items = ["".join(c if c.isascii() else "e" for c in sentence(8000 + i, 4 + i % 40)).lower() for i in range(80)]
    rows = [(i, sentence(8200 + i, 30) + " " + spread(t, kind) + " " + sentence(8400 + i, 30)) for i, t in enumerate(items)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leaks(frame, spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()}
    near = [(i, i) for i, t in enumerate(items) if edit_search(t.encode(), rows[i][1].lower().encode())[0] <= int(0.2 * len(t))]
    assert len(near) >= 60 and set(near) <= got


@pytest.mark.parametrize("max_edit", [0.05, 0.2, 0.3])
def test_settler_equals_brute_force(max_edit):
    r = random.Random(3)
    items = [bytes(r.choice(b"abcde ") for _ in range(r.randrange(1, 150))) for _ in range(60)]
    texts = [b"".join(bytes(r.choice(b"abcde ") for _ in range(r.randrange(60))) + edited(r, t, r.randrange(min(int(max_edit * len(t)) + 3, len(t)))) for t in r.sample(items, 2)) for _ in range(40)] + [b"", b"abc"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = {(d, i) for settler in settlers(items, max_edit) for d, i, a, b in settler.regions(data, offsets) if edit_search(items[i], data[a:b].tobytes())[0] <= int(max_edit * len(items[i]))}
    assert found == {(d, i) for d, t in enumerate(texts) for i, p in enumerate(items) if edit_search(p, t)[0] <= int(max_edit * len(p))}


def test_leaks_equal_brute_force(spark):
    """All distances up to the largest, items from one byte on, edits of every kind."""
    r = random.Random(21)
    items = [b"q", b"zzzz", b"vwxyz", *(bytes(r.choice(b"abcdefghij ") for _ in range(r.randrange(6, 200))).strip() or b"x" for _ in range(25))]
    rows = []
    for i in range(120):
        t = items[i % len(items)]
        rows.append((i, (bytes(r.choice(b"klmno ") for _ in range(r.randrange(50))) + edited(r, t, r.randrange(min(int(0.2 * len(t)) + 2, len(t)))) + bytes(r.choice(b"klmno ") for _ in range(r.randrange(50)))).decode()))
    norm = lambda t: normalise(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in leaks(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), spark.createDataFrame([(i, t.decode()) for i, t in enumerate(items)], "item_id bigint, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, p in enumerate(items):
            p = norm(p).strip()
            edits = distance_to_substring(p, norm(t.encode()))
            if edits <= int(0.2 * len(p)):
                want[d, i] = edits
    assert len(want) > 100 and got == want


def test_a_very_long_item(spark):
    """A megabyte: parts bound the tables, and an exact place needs no edit distance."""
    r = random.Random(6)
    long = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(95_000))
    assert len(long) > 1_000_000
    docs = spark.createDataFrame([(1, "gammY " + long.upper() + " after"), (2, "gamey"), (3, "nothing of it")], "doc_id bigint, text string")
    got = leaks(docs, spark.createDataFrame([(9, long), (8, "gammy")], "item_id bigint, text string")).collect()
    assert {(x["doc_id"], x["item_id"], x["edits"]) for x in got} == {(1, 9, 0), (1, 8, 0), (2, 8, 1)}


def test_empty(spark, docs, empty, texts):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs, none).count() == 0 and decontaminated(docs, none).count() == len(texts)
    assert leaks(empty, spark.createDataFrame([(1, sentence(2, 60))], "item_id bigint, text string")).count() == 0


def test_few_places_of_an_item_are_searched():
    """Pieces of a whole item narrow the places down, not those of each 64 bytes of it."""
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshr", k=r.randrange(2, 8))) for _ in range(400)]
    items = [" ".join(r.choices(words, k=45))[:230].strip().encode() for _ in range(100)]
    (settler,) = settlers(items, 0.2)
    assert settler.need.min() >= 8 and len(settler.size) == len(items)
    text = bytearray(" ".join(r.choices(words, k=40000)).encode())
    text[100_000 : 100_000 + len(items[7])] = items[7]
    data = np.frombuffer(bytes(text), np.uint8)
    places = settler.places(data)
    assert any(p == 7 and a <= 100_000 <= b for p, a, b in places.tolist())
    assert {(d, i) for d, i, a, b in settler.regions(data, np.array([0, len(data)])) if bytes(text[a:b]).find(items[i]) >= 0} == {(0, 7)}
    assert len(places) < len(data) // 10


def test_chosen_pieces_are_the_cheapest_disjoint_ones():
    from itertools import combinations

    from quillspark.llm.decontaminate import chosen_pieces

    r = np.random.default_rng(3)
    costs = [r.integers(0, 9, n).astype(float) for n in (1, 4, 9, 14, 14)]
    counts = np.array([1, 1, 3, 2, 4])
    for cost, k, got in zip(costs, counts.tolist(), chosen_pieces(costs, 4, counts), strict=True):
        assert len(got) == k and got.min() >= 0 and got.max() < len(cost) and np.all(np.diff(got) >= 4)
        want = min(sum(cost[i] for i in c) for c in combinations(range(len(cost)), k) if all(b - a >= 4 for a, b in zip(c, c[1:])))
        assert cost[got].sum() == want


def test_one_piece_many_times_is_no_place():
    """A place needs different pieces: a text of one word holds one piece of an item often."""
    item = b"abcd" + bytes(97 + (7 * i + i // 5) % 26 for i in range(196))
    (settler,) = settlers([item], 0.2)
    assert len(settler.places(np.frombuffer(b"abcd" * 500, np.uint8))) == 0
    text = np.frombuffer(b"abcd" * 100 + item + b"abcd" * 100, np.uint8)
    assert any(a <= 400 <= b for _, a, b in settler.places(text).tolist())
