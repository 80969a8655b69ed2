from __future__ import annotations

import zlib

import numpy as np
import pytest

from quillspark.llm.packing import combinations, nnls, pack
from quillspark.llm.queries import tokenizer_path


def test_nnls_meets_the_optimality_conditions():
    r = np.random.default_rng(1)
    a, b = r.random((12, 30)), r.random(12)
    x = nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6
    assert np.allclose(nnls(np.eye(3), np.array([1.0, 2.0, 0.0])), [1, 2, 0])


def test_combinations_fill_the_window():
    rows = combinations(8, 3)
    sizes = np.arange(1, 9)
    assert (rows @ sizes == 8).all() and rows.sum(1).max() == 3 and len({tuple(r) for r in rows.tolist()}) == len(rows) == 10


@pytest.mark.parametrize("block", [3_000_000, 4000])
def test_round_trip(docs, texts, block):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = pack(docs, tokenizer_path(), block_tokens=block).collect()
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts)
    sequences, pieces = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 2048
    used = sum(n for s in sequences.values() for _, n in s)
    assert used == sum(map(len, want))
    assert len(sequences) * 2048 - used <= 3 * 2048  # one open sequence a task
    got = sorted(sum((ids for _, ids in sorted(p)), []) for key, p in pieces.items() if key[0] not in (None, 7))
    assert got == sorted([*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts if i not in (None, 7))


def test_special_tokens_are_what_the_tokenizer_says(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "<|endof", "  <|endoftext|>\n\n"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), tokenizer_path()).collect()
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in rows}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got[0] == [87, 220, 50256, 331, 1]


def test_ids_equal_the_tokenizer_on_arbitrary_texts():
    import random

    from tokenizers import Tokenizer

    from quillspark.llm.packing import _encoder

    tok, encode, r = Tokenizer.from_file(tokenizer_path()), _encoder(tokenizer_path()), random.Random(1)
    parts = ["<|endoftext|>", " ", "  ", "\n", "the", "Ing", "é", "ß", "12345", "'ll", "'", "你好", "\U0001f600", "_", "\t", "a", "zz", "\u00a0", "\u2028", "-", "<|", "|>"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(3000)] + ["".join(chr(r.choice([r.randrange(32, 500), r.randrange(0x3000, 0x9000)])) for _ in range(40)) for _ in range(500)]
    assert encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty(empty):
    assert pack(empty, tokenizer_path()).count() == 0
