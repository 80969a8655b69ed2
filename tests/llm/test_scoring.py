from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.context_tree import DEPTH, Crown, canonical, gram_keys, partial, subtree
from quillspark.llm.lm_scoring import score_corpus
from quillspark.llm.textkit import word_slices
from tests.llm.conftest import sentence


def brute(train: list[bytes], text: bytes, depth: int) -> float:
    """log10 probability by the plain recursion over context strings."""
    counts: dict = {}
    for t in train:
        padded = b"\n" * depth + t
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for j in range(8):
                    n = counts.setdefault((padded[i - d : i], padded[i] >> (8 - j), j), [0, 0])
                    n[padded[i] >> (7 - j) & 1] += 1
    kids: dict = {}
    for c, p, j in counts:
        if c:
            kids.setdefault((c[1:], p, j), []).append((c, p, j))

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - 2 * math.lgamma(0.5)

    memo: dict = {}

    def weighted(key):
        if key not in memo:
            own = kt(counts[key])
            memo[key] = own if len(key[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(k) for k in kids.get(key, [])))
        return memo[key]

    total, padded = 0.0, b"\n" * depth + text
    for i in range(depth, len(padded)):
        for j in range(8):
            p = 0.5
            for d in range(depth, -1, -1):
                key = (padded[i - d : i], padded[i] >> (8 - j), j)
                if key in counts:
                    n = counts[key]
                    own = 1.0 if d == depth else math.exp(math.log(0.5) + kt(n) - weighted(key))
                    p = own * (n[1] + 0.5) / (sum(n) + 1) + (1 - own) * p
            total += math.log10(p if padded[i] >> (7 - j) & 1 else 1 - p)
    return total


def canon(t):
    return b" ".join((t or "").encode().lower().split()) + b"\n"


def model(keys, counts, depth, floor):
    levels = subtree(keys, counts, depth, floor)
    crown = Crown(levels.roots, floor)
    return lambda asked: crown.log10(asked, partial(levels, asked))


@pytest.mark.parametrize("floor", [0, 1, 2, 3])
def test_tree_equals_the_plain_recursion(floor):
    import pyarrow as pa

    train, test, depth = ["the cat sat", "The hat, the mat", "", "aaaa"], ["the cat", "zebra  hat", None, "\x7f\x80"], 3
    held = [gram_keys(*canonical(w, depth)[:2], depth) for _, _, w in word_slices(pa.array(train))]
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    log10 = model(keys, n, depth, floor)
    for _, _, w in word_slices(pa.array(test, pa.string())):
        padded, at, ends = canonical(w, depth)
        got = np.add.reduceat(log10(gram_keys(padded, at, depth)), ends[:-1])
    assert got == pytest.approx([brute([canon(t) for t in train], canon(t), depth) for t in test], abs=1e-6)


@pytest.mark.parametrize("floor", [0, 1])
def test_a_distribution_over_bytes(floor):
    keys = np.array([(ord("a") << 56) | ord("b"), (ord("a") << 56) | ord("c"), (ord("b") << 56) | ord("a")], np.uint64)
    log10 = model(keys, np.array([5, 2, 9]), 1, floor)
    for context in (ord("a"), ord("z")):
        every = np.array([(context << 56) | b for b in range(256)], np.uint64)
        assert (10 ** log10(every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("head_pairs", [10**6, 40, 0])
def test_corpus_scores_equal_the_plain_recursion(spark, head_pairs):
    texts = [(i, sentence(i, 3 + i % 4)) for i in range(24)] + [(30, None), (None, "The hat  and\nthe mat"), (31, "")]
    got = score_corpus(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), head_pairs=head_pairs).collect()
    train = [canon(t) for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    assert any(r["held_out"] for r in got)
    want = {i: brute(train, canon(t), DEPTH) for i, t in texts}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-3)


def test_without_training_every_bit_is_even(spark):
    (row,) = score_corpus(spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "ab")], "doc_id bigint, text string")).collect()
    assert row["score"] == pytest.approx(24 * math.log10(0.5)) and row["held_out"] and row["train_tokens"] == 0


@pytest.mark.parametrize("head", [400_000, 3])
def test_base_and_held_out(docs, texts, head):
    got = score_corpus(docs, head=head).collect()
    train = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in (t or "").encode().lower().split())
    total, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, t in texts:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c[w] + 1) / (total + v + 1)) for w in words) + math.log10((len(train) + 1) / (total + v + 1))
        want.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words) + 1, sum(w in c for w in words) + 1, total, round(base, 6)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_empty(empty):
    assert score_corpus(empty).count() == 0
