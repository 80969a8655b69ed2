from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from quillspark.llm.alignment import Aligned, byte_level, links, pieces
from quillspark.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = ["<|endoftext|> as text", "naïve über 12345!\n\n  x", "你好 \U0001f600 ... \r\n", "ﬁ ligature", "a▁b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 40, " ", "\x00\x01", "é é"]


def brute(texts):
    """Every definition word by word, with token lists and offsets in Python, by the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

    def piece(p):
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for t in texts:
        groups = []
        if t:
            a = tok.encode(" " + t, add_special_tokens=False)
            b = sp.encode(t)
            bytes_a = [bytes(byte_of[c] for c in x) for x in a.tokens]
            bytes_b = [piece(sp.id_to_piece(i)) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(bytes_a) or j < len(bytes_b):
                    if at_a <= at_b and i < len(bytes_a):
                        left.append(a.ids[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        right.append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((left, right))
                        left, right = [], []
        pairs = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(pairs.keys())
        found.append((groups, pairs))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for groups, pairs in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in pairs.items() if counts[p] == most[p[0]])
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(pairs.values()), best, sum(n * counts[p] for p, n in pairs.items()), hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return rows


@pytest.mark.parametrize("head", [1_000_000, 500, 0])
def test_equals_brute_force(spark, docs, texts, head):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    all_docs = docs.select("doc_id", "text").union(more)
    got = [tuple(r[c] for c in ["doc_id", *FIELDS]) for r in links(all_docs, A, B, head=head, with_groups=False).collect()]
    ids = [i for i, _ in texts] + [1000 + i for i in range(len(HARD))]
    want = [(i, *row) for i, row in zip(ids, brute([t for _, t in texts] + HARD), strict=True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_groups_are_returned(docs):
    rows = links(docs, A, B).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert sum(r["a_sizes"]) == r["n_a"] == len(r["a_ids"]) and sum(r["b_sizes"]) == len(r["b_ids"]) and len(r["a_sizes"]) == r["n_groups"]
        assert sum(x * y for x, y in zip(r["a_sizes"], r["b_sizes"], strict=True)) == r["n_links"]


def test_wide_groups_count_distinct_ids():
    texts = [t for t in HARD if t]
    block = Aligned(texts, byte_level(A), pieces(B))
    assert all((x == y).all() for x, y in zip(block.pairs(widest=64), block.pairs(widest=0), strict=True))


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" " + "".join(points[i : i + 500]) for i in range(0, 60_000, 500)] + [" a" + " b1".join(points[i : i + 50]) for i in range(0, 12_000, 50)]
    assert byte_level(A).encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(empty):
    assert links(empty, A, B).count() == 0
