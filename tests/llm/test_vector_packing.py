from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm.queries import tokenizer_path
from quillspark.llm.vector_packing import WordEncoder, best_fit, pack_vectors

WORDS = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity, weights):
    """Best fit decreasing by the norm rule, a piece at a time."""
    capacity = np.array(capacity, float)
    demand = np.array([lengths.sum(), len(lengths), (lengths.astype(float) ** 2).sum()])
    weight = demand / capacity if weights is None else np.array(weights, float)
    left, bins = [], np.zeros(len(lengths), int)
    for i in np.argsort(-lengths, kind="stable"):
        item = np.array([lengths[i], 1, lengths[i] ** 2], float)
        fits = [b for b, r in enumerate(left) if (r >= item).all()]
        if not fits:
            left.append(capacity.copy())
            fits = [len(left) - 1]
        best = min(fits, key=lambda b: ((weight * ((left[b] - item) / capacity) ** 2).sum(), b))
        left[best] -= item
        bins[i] = best
    return bins


@pytest.mark.parametrize("capacity", [(2048, 2048, 2048**2), (2048, 3, 2048**2), (2048, 9, 1_500_000)])
@pytest.mark.parametrize("weights", [None, (1.0, 0.0, 0.0)])
def test_norm_rule_equals_one_piece_after_another(capacity, weights):
    r = np.random.default_rng(5)
    lengths = np.r_[r.integers(1, 1200, 300), r.integers(1, 40, 200), [7] * 50]
    bins, offsets = best_fit(lengths, *capacity, weights=weights)
    assert len(set(bins)) == len(set(one_by_one(lengths, capacity, weights)))
    for b in set(bins):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
        assert lengths[own].sum() <= capacity[0] and len(own) <= capacity[1] and (lengths[own] ** 2).sum() <= capacity[2]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_few_sequences(rule):
    r = np.random.default_rng(6)
    lengths = np.minimum(2047, r.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    bins, _ = best_fit(lengths, rule=rule)
    assert len(set(bins)) <= -(-lengths.sum() // 2048) * 1.01 + 1
    bins, _ = best_fit(lengths, 2048, 4, 2_000_000, rule) if lengths.max() ** 2 <= 2_000_000 else best_fit(np.minimum(lengths, 1400), 2048, 4, 2_000_000, rule)
    assert np.bincount(bins).max() <= 4


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 64]) for i in range(0, 70_000, 64)] + [" A".join(points[i : i + 8]) for i in range(0, 12_000, 8)]
    texts += ["J̌ J ̌ ́x", "<|endoftext|>a <|ENDOFTEXT|> <|startoftext|>", "It's I'LL 'Twas rock'n'roll", "a\x1cb\x85c\x0bd　e f", "", " \n\t"]
    encode = WordEncoder(WORDS, cached=200)
    for _ in range(2):
        for i in range(0, len(texts), 500):
            ids, first = encode(pa.array(texts[i : i + 500], pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in model.encode_batch(texts[i : i + 500], add_special_tokens=False)]


@pytest.mark.parametrize("block", [1 << 16, 20])
def test_round_trip(docs, texts, block):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    rows = pack_vectors(docs, WORDS, block=block).collect()
    want = sorted(((i is None, i or 0, [*model.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts))
    sequences, pieces = {}, []
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.append((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], ids))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    whole = [p for p in pieces if sum(q[:2] == p[:2] for q in pieces) == 1]
    assert sorted(w for w in want if sum(v[:2] == w[:2] for v in want) == 1 and len(w[2]) <= 2048) == sorted((n, i, ids) for n, i, _, ids in whole)
    long = next(w for w in want if len(w[2]) > 2048)
    parts = sorted(p for p in pieces if p[:2] == long[:2])
    assert [x for p in parts for x in p[3]] == long[2] and all(len(p[3]) == 2048 for p in parts[:-1])
    total = sum(r["length"] for r in rows)
    assert block == 20 or len(sequences) <= -(-total // 2048) + 1


def test_other_capacities(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[r.randrange(8)] for _ in range(r.randrange(1, 300)))) for i in range(200)], "doc_id bigint, text string")
    rows = pack_vectors(docs, WORDS, window=256, max_docs=3, max_cost=200 * 200, rule="dot", with_ids=False).collect()
    by = {}
    for row in rows:
        by.setdefault(row["sequence_id"], []).append(row["length"])
    assert all(len(v) <= 3 and sum(v) <= 256 and sum(x * x for x in v) <= 200 * 200 for v in by.values())
    with pytest.raises(ValueError):
        pack_vectors(docs, WORDS, max_docs=0)


def test_empty_table(empty):
    assert pack_vectors(empty, WORDS).count() == 0
