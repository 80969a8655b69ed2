"""Cross-tokenizer alignment: where two tokenizers cut the same text, and which ids meet there.

A text is encoded twice, ``" " + text`` by a byte-level BPE (A) and ``text`` by a piece
model that puts a blank in front (B), so both spell the same bytes.  A whole Arrow batch is
one byte string with document offsets: the ends of all tokens of A and of B are counted once
per byte (``bincount``), the text is cut where both occur, and prefix sums over bytes and
groups, read at the document offsets, give each document's numbers.  No loop runs over
tokens or documents except for the two encoders and the digest.

Every A-B pair of token occurrences in one group is a link.  How many documents hold an id
pair is counted in Spark; its most frequent pairs (at most ``head``, a fixed bound) go to the
tasks as an array and resolve nearly all links, the others are joined.  Each document
carries an id pair once with its number of links, whatever the size of a group.

Defined cases: a null or empty text, and one that either tokenizer doesn't spell byte for
byte (B normalises some), has no tokens, zeros and an empty digest; special tokens' strings
are plain text; repeated rows and rows with null ids count each as a document; ties for an A
id's highest count are all best; very long texts are aligned whole, in a block of their own;
an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, small_batches
from quillspark.llm.lm_scoring import _Table, frequent
from quillspark.llm.textkit import mix64, offsets_of, slices, text_buffer

BLOCK_BYTES = 2 << 20
HEAD = 1_000_000
_SHIFT = 20  # bits of an id; a pair is A << 20 | B
_PAIR = 2 * _SHIFT


class Vocabulary:
    """An encoder with the bytes that each of its ids stands for."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]) -> None:
        if len(entries) > 1 << _SHIFT:
            raise ValueError("the vocabulary is too large for a pair's bits")
        self.encode = encode
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = offsets_of(self.sizes)
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's place among them (n+1)."""
        lists = self.encode(texts)
        first = offsets_of([len(x) for x in lists])
        return np.fromiter((i for x in lists for i in x), np.int64, int(first[-1])), first

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE of a ``tokenizers`` file, special tokens' strings as plain text.  Its merges
    run in ``tiktoken``, which gives the same ids with less work, once both agree on a probe."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if i not in special}
    by_id = {i: b for b, i in ranks.items()} | special
    entries = [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True

    def exact(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    quick = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(texts: list[str]) -> list[list[int]]:
        return [quick.encode_ordinary(t) for t in texts]

    probe = ["", " It's 3.14,\tnaïve über 12345!\n\n  x  <|endoftext|>", " 你好 \U0001f600 ...  \r\n a_b 'll ''t", *(b.decode(errors="ignore") for b in ranks)]
    return Vocabulary(by_ranks if by_ranks(probe) == exact(probe) else exact, entries)


@lru_cache(maxsize=2)
def pieces(path: str) -> Vocabulary:
    """A ``sentencepiece`` model: U+2581 is a blank, <0xHH> a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)

    def entry(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:5], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode()

    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), [entry(i) for i in range(model.get_piece_size())])


@lru_cache(maxsize=8)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0..n-1 as rows with room for one more byte, and their numbers."""
    words = np.arange(n).astype("S")
    table = np.zeros((n, words.dtype.itemsize + 1), np.uint8)
    table[:, :-1] = words.view(np.uint8).reshape(n, -1)
    return table, (table > 0).sum(1)


def _sums(values: np.ndarray) -> np.ndarray:
    """0 and the prefix sums."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Aligned:
    """The groups of a block of documents; the arrays named ``*_first`` have one entry more than
    there are documents and say where each one's part begins."""

    def __init__(self, texts: list[str], a: Vocabulary, b: Vocabulary) -> None:
        want = [b" " + t.encode() if t else b"" for t in texts]
        sides = [a.ids([" " + t if t else "" for t in texts]), b.ids([t if t else "" for t in texts])]
        sizes = np.array([len(w) for w in want], np.int64)
        alike = sizes > 0
        for vocabulary, (ids, first) in zip((a, b), sides, strict=True):
            alike &= np.diff(_sums(vocabulary.sizes[ids])[first]) == sizes
        # documents whose tokens are as long as the text: compare the bytes
        data = np.frombuffer(b"".join(w for w, y in zip(want, alike, strict=True) if y), np.uint8)
        at = offsets_of(np.where(alike, sizes, 0))
        for vocabulary, (ids, first) in zip((a, b), sides, strict=True):
            wrong = _sums(vocabulary.spelled(ids[np.repeat(alike, np.diff(first))]) != data)
            alike &= np.diff(wrong[at]) == 0
        (self.a, self.a_first), (self.b, self.b_first) = ((ids[np.repeat(alike, np.diff(first))], offsets_of(np.where(alike, np.diff(first), 0))) for ids, first in sides)
        at = offsets_of(np.where(alike, sizes, 0))
        n = int(at[-1])
        # one count of ends per byte for the whole block; a cut is where both have one
        end_a = np.bincount(np.cumsum(a.sizes[self.a]), minlength=n + 1)
        end_b = np.bincount(np.cumsum(b.sizes[self.b]), minlength=n + 1)
        both = (end_a > 0) & (end_b > 0)
        cuts = np.flatnonzero(both)
        self.a_end, self.b_end = np.cumsum(end_a)[cuts], np.cumsum(end_b)[cuts]
        self.in_a, self.in_b = np.diff(self.a_end, prepend=0), np.diff(self.b_end, prepend=0)
        self.first = np.cumsum(both)[at]
        self.links = np.diff(_sums(self.in_a * self.in_b)[self.first])

    def pairs(self, widest: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's distinct id pairs (A << 20 | B) with their numbers of links, sorted, and
        where each document's begin.  A group of more than `widest` links is counted by distinct ids."""
        doc_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        size = self.in_a * self.in_b
        small = np.flatnonzero(size <= widest)
        g = np.repeat(small, size[small])
        r = np.arange(len(g)) - np.repeat(_sums(size[small])[:-1], size[small])
        left = (self.a_end - self.in_a)[g] + r // self.in_b[g]
        right = (self.b_end - self.in_b)[g] + r % self.in_b[g]
        keys, times = [doc_of[g] << _PAIR | self.a[left] << _SHIFT | self.b[right]], [np.ones(len(g), np.int64)]
        if len(doc_of) and doc_of[-1] >= 1 << 23:
            raise ValueError("too many documents in a block")
        for i in np.flatnonzero(size > widest):
            x, nx = np.unique(self.a[self.a_end[i] - self.in_a[i] : self.a_end[i]], return_counts=True)
            y, ny = np.unique(self.b[self.b_end[i] - self.in_b[i] : self.b_end[i]], return_counts=True)
            keys.append((doc_of[i] << _PAIR | x[:, None] << _SHIFT | y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
        key, n = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key)
        key, n = key[order], n[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, head) if len(key) else n
        key = key[head]
        begin = np.searchsorted(key >> _PAIR, np.arange(len(self.first)))
        return key & (1 << _PAIR) - 1, total, begin

    def digests(self) -> list[str]:
        """The SHA-256 of each document's groups, as ``a1,a2|b1;a3|b2,b3`` in decimal ids."""
        groups = np.arange(len(self.in_a))
        group_a, group_b = np.repeat(groups, self.in_a), np.repeat(groups, self.in_b)
        place_a = np.arange(len(self.a)) + (self.b_end - self.in_b)[group_a]
        place_b = np.arange(len(self.b)) + self.a_end[group_b]
        total = len(self.a) + len(self.b)
        ids, after = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[(self.a_end + self.b_end - self.in_b - 1)] = ord("|")
        after[(self.a_end + self.b_end - 1)] = ord(";")
        table, sizes = _decimals(int(ids.max(initial=0)) + 1)
        width, digits = table.shape[1] - 1, sizes[ids]
        text = table[ids]
        text[np.arange(total), digits] = after
        flat = text[np.arange(width + 1)[None, :] <= digits[:, None]]
        at = _sums(digits + 1)[self.a_first + self.b_first]
        data = flat.tobytes()
        return [sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def aligned(docs: DataFrame, a_path: str, b_path: str, *, with_groups: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``row`` (a number of its own), ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``groups_sha256``, its id pairs (``pairs``, A << 20 | B) and their numbers of
    links (``times``); with `with_groups` also the ids of both sides and how many of them
    each group has (``a_ids``, ``b_ids``, ``a_sizes``, ``b_sizes``)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36

        def lists(values: np.ndarray, first: np.ndarray, kind: type) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(kind)))

        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for s, e in slices(offsets, block_bytes):
                block = Aligned([t or "" for t in batch.column(1).slice(s, e - s).to_pylist()], a, b)
                pair, times, begin = block.pairs()
                out = {
                    "row": pa.array(np.arange(row, row + e - s)),
                    "doc_id": batch.column(0).slice(s, e - s),
                    "n_a": pa.array(np.diff(block.a_first)),
                    "n_b": pa.array(np.diff(block.b_first)),
                    "n_groups": pa.array(np.diff(block.first)),
                    "n_links": pa.array(block.links),
                    "groups_sha256": pa.array(block.digests(), pa.string()),
                    "pairs": lists(pair, begin, np.int64),
                    "times": lists(times, begin, np.int64),
                }
                if with_groups:
                    out |= {"a_ids": lists(block.a, block.a_first, np.int32), "b_ids": lists(block.b, block.b_first, np.int32), "a_sizes": lists(block.in_a, block.first, np.int32), "b_sizes": lists(block.in_b, block.first, np.int32)}
                row += e - s
                yield pa.RecordBatch.from_pydict(out)

    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    return source.mapInArrow(run, schema + (", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>" if with_groups else ""))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents of :func:`aligned` an id pair is linked, and whether
    that is the highest number of its A id."""
    counts = saved(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    # one row an A id: as many as the vocabulary has, whatever the corpus
    most = counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", _SHIFT) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def links(docs: DataFrame, a_path: str, b_path: str, *, head: int = HEAD, with_groups: bool = True) -> DataFrame:
    """The columns of :func:`aligned` without pairs, and of the document's links: how many are an A id's
    most frequent one (``n_best``) and the sum of their pairs' counts (``count_sum``)."""
    spark = docs.sparkSession
    rows = saved(aligned(docs, a_path, b_path, with_groups=with_groups), "aligned")
    counts = saved(pair_counts(rows), "best-pairs").withColumn("worth", 2 * F.col("n") + F.col("best").cast("long"))
    keys, values = frequent(counts, head, "pair", "worth")
    order = np.argsort(mix64(keys))  # the table looks keys up by their leading bits
    shipped = spark.sparkContext.broadcast((mix64(keys)[order], values[order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(*shipped.value)
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                first = np.asarray(part.column(1).offsets)
                first = (first - first[0]).astype(np.int64)
                pair, times = (part.column(i).flatten().to_numpy() for i in (1, 2))
                worth = table.get(mix64(pair.view(np.uint64)))
                known = worth >= 0
                n, best = np.where(known, worth >> 1, 0), known & (worth & 1 > 0)
                rare = _sums(~known)[first]
                sums = [np.diff(_sums(x)[first]) for x in (times * best, times * n)]
                left = [pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(x[~known])) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums), *left], names=["row", "head_best", "head_sum", "rare", "rare_times"])

    found = saved(rows.select("row", "pairs", "times").mapInArrow(run, "row bigint, head_best bigint, head_sum bigint, rare array<bigint>, rare_times array<bigint>"), "linked")
    each = found.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    # merged at every size, as in a corpus of which the table would never fit a broadcast
    rest = each.join(counts.hint("merge"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    sums = found.select("row", "head_best", "head_sum").join(rest, "row", "left")
    sums = sums.select("row", (F.col("head_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").drop("row")
