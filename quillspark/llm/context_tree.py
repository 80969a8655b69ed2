"""Context-tree weighting over bytes, trained on the corpus and frozen for scoring.

A text is canonicalised to its lower-case words (A-Z only) joined by one space and
closed by one newline, the end token.  Each byte is decomposed into eight binary
decisions; every decision has a tree of contexts of 0..``depth`` preceding bytes.
A node's Krichevsky-Trofimov estimate over the corpus counts is weighted against
its children's by the usual recursion ``Pw = Pe/2 + prod(Pw(children))/2``, bottom
up, and a decision's probability is the mixture along its path with the posterior
weights.  A context that the corpus lacks gives 1/2 from there on, so the model is
a proper distribution over texts.

What is gathered from the corpus are the counts of all (context, byte) pairs, however
many: each task counts its own, Spark adds them up, and nothing is dropped or rolled up.
The tree is computed in parts.  Contexts that share their ``FLOOR`` nearest bytes are a
subtree, which one task builds bottom up and walks top down for the pairs below it; the
tasks hand up one row a node at that depth, and the driver adds the few levels above
(at most 256**2 contexts of 255 nodes, whatever the corpus).  The result is a table of
the log10 probability of every pair that any text asks for.

The canonical form is the token sequence, which is also what the unigram base scores, so
the two numbers are probabilities of the same event; how many blanks or which kind of
them part two tokens is no part of it.

Defined cases: null and empty texts are the end token alone; a null id trains; without
any training text every bit has probability 1/2; repeated rows and ties count and score
as rows; very long texts are scored whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, small_batches
from quillspark.llm.textkit import Words, _lower, offsets_of, text_buffer, word_slices

DEPTH = 6
FLOOR = 2
CHUNK = 300_000


def canonical(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded canonical bytes of a slice: each document is `depth` newlines, then its
    text.  Also the position of each byte that is predicted and of each document's end."""
    n_docs = len(words.first) - 1
    size = words.end - words.start + 1
    count = np.diff(words.first)
    word_at = offsets_of(size)
    doc_len = word_at[words.first[1:]] - word_at[words.first[:-1]]
    doc_len[count == 0] = 1
    doc_at = offsets_of(doc_len + depth)
    out = np.full(int(doc_at[-1]), 10, np.uint8)
    # where each word starts in the output
    own = doc_at[:-1] + depth - word_at[words.first[:-1]]
    start = word_at[:-1] + np.repeat(own, count)
    shift = np.repeat(words.start - word_at[:-1], size)
    flat = np.arange(int(word_at[-1]))
    source = np.minimum(flat + shift, max(len(words.data) - 1, 0))
    target = flat + np.repeat(start - word_at[:-1], size)
    if len(flat):
        out[target] = _lower[words.data[source]]
        out[start + size - 1] = 32
    out[doc_at[1:] - 1] = 10
    predicted = np.ones(len(out), bool)
    pads = doc_at[:-1]
    for k in range(depth):
        predicted[pads + k] = False
    assert len(doc_at) == n_docs + 1
    return out, np.flatnonzero(predicted), offsets_of(doc_len)


def gram_keys(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Context and byte as one number: the preceding byte on top, then the one before
    it, down to `depth` bytes; the byte itself is lowest.  Sorted keys walk the tree."""
    key = padded[at].astype(np.uint64)
    for k in range(1, depth + 1):
        key |= padded[at - k].astype(np.uint64) << np.uint64(64 - 8 * k)
    return key


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.astype(float).copy()
    for _ in range(8):
        small = y < 9
        shift = np.where(small, shift - np.log(np.where(small, y, 1)), shift)
        y = np.where(small, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def _mask(depth: int) -> np.uint64:
    return np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * depth)) - 1)) if depth else np.uint64(0)


def _node(key: np.ndarray, d: int, j: int) -> np.ndarray:
    """Context of d bytes and the j leading bits of the byte (with a leading one as a mark)."""
    low = ((key & np.uint64(255)) >> np.uint64(8 - j)) | np.uint64(1 << j)
    return (key & _mask(d)) | low


def _above(node: np.ndarray, d: int) -> np.ndarray:
    """The same bits in the context of d bytes."""
    return (node & _mask(d)) | (node & np.uint64(255))


class Levels:
    """Nodes of the tree at the depths ``top`` .. ``floor`` (top is the deepest), from the
    deepest level's nodes: a name, the counts of ones and of all, and the weighted log
    probability.  Per (depth, bit): sorted names, the estimate of a one, and the weight of
    the node's own estimate against its children's."""

    def __init__(self, top: int, floor: int, deepest: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]) -> None:
        self.top, self.floor = top, floor
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for j, (names, ones, total, log_w) in enumerate(deepest):
            for d in range(top, floor - 1, -1):
                if d < top:
                    below = log_w
                    names, index = np.unique(_above(names, d), return_inverse=True)
                    ones, total, kids = (np.bincount(index, x, len(names)) for x in (ones, total, below))
                log_kt = _log_gamma(ones + 0.5) + _log_gamma(total - ones + 0.5) - _log_gamma(total + 1.0) - 2 * math.lgamma(0.5)
                if d < top:
                    log_w = math.log(0.5) + np.logaddexp(log_kt, kids)
                elif log_w is None:
                    log_w = log_kt
                own = np.exp(math.log(0.5) + log_kt - log_w) if d < top else np.ones(len(names))
                self.nodes[d, j] = (names, (ones + 0.5) / (total + 1), own)
            self.roots.append((names, ones, total, log_w))

    def mixture(self, node: np.ndarray, j: int, p: np.ndarray) -> np.ndarray:
        """P(one) at `floor` for the nodes of the deepest level, with `p` where none is known."""
        for d in range(self.top, self.floor - 1, -1):
            names, kt, own = self.nodes[d, j]
            if not len(names):
                continue
            at = _above(node, d)
            i = np.minimum(np.searchsorted(names, at), len(names) - 1)
            p = np.where(names[i] == at, own[i] * kt[i] + (1.0 - own[i]) * p, p)
        return p


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, floor: int) -> Levels:
    """The nodes from `depth` up to `floor` of the pairs that occur (those with a count)."""
    known, n = keys[counts > 0], counts[counts > 0].astype(float)
    deepest = []
    for j in range(8):
        names, index = np.unique(_node(known, depth, j), return_inverse=True)
        bit = (known >> np.uint64(7 - j)) & np.uint64(1)
        deepest.append((names, np.bincount(index, n * bit, len(names)), np.bincount(index, n, len(names)), None))
    return Levels(depth, floor, deepest)


def partial(levels: Levels, keys: np.ndarray) -> np.ndarray:
    """P(one) of each pair's eight decisions, mixed up to the tree's floor."""
    half = np.full(len(keys), 0.5)
    return np.stack([levels.mixture(_node(keys, levels.top, j), j, half) for j in range(8)], 1)


class Crown:
    """The levels above ``FLOOR``: adds them to what the subtrees have mixed."""

    def __init__(self, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], floor: int) -> None:
        self.floor, levels = floor, Levels(floor, 0, roots)
        # a mixture is linear in what comes from below, so two walks give it for any p
        self.line = []
        for j, (names, *_) in enumerate(roots):
            context = np.unique(_above(names, floor - 1)) if floor else names
            zero = self._walk(levels, context, j, 0.0)
            self.line.append((context, zero, self._walk(levels, context, j, 1.0) - zero))
        self.levels = levels

    def _walk(self, levels: Levels, node: np.ndarray, j: int, p: float) -> np.ndarray:
        out = np.full(len(node), p)
        for d in range(self.floor - 1, -1, -1):
            names, kt, own = levels.nodes[d, j]
            if len(names):
                at = _above(node, d)
                i = np.minimum(np.searchsorted(names, at), len(names) - 1)
                out = np.where(names[i] == at, own[i] * kt[i] + (1.0 - own[i]) * out, out)
        return out

    def log10(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each pair."""
        total = np.zeros(len(keys))
        for j in range(8):
            node = _node(keys, max(self.floor - 1, 0), j)
            names, base, slope = self.line[j]
            p = below[:, j].astype(float)
            if self.floor:
                i = np.minimum(np.searchsorted(names, node), max(len(names) - 1, 0))
                hit = names[i] == node if len(names) else np.zeros(len(node), bool)
                lost = np.flatnonzero(~hit)
                mixed = np.where(hit, base[i] + slope[i] * p, 0.0) if len(names) else np.zeros(len(node))
                mixed[lost] = self._walk(self.levels, node[lost], j, 0.5)
                p = mixed
            one = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(one, p, 1 - p))
        return total


class Scorer:
    """Looks frequent pairs up in an open hash table; others are not found."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        order = np.argsort(keys)
        self.known, self.known_log = keys[order], logs[order].astype(np.float32)
        self.bits = max(8, (2 * len(keys)).bit_length())
        # key and value side by side, so that a look-up touches memory once
        self.table = np.zeros((1 << self.bits, 2), np.uint64)
        self.table[:, 1] = np.full(1, np.nan).view(np.uint64)
        slot = self._slot(self.known)
        _, first = np.unique(slot, return_index=True)  # one pair a slot; the rest is found by order
        self.table[slot[first], 0] = self.known[first]
        self.table[slot[first], 1] = self.known_log[first].astype(float).view(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) ^ (keys >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each pair's probability, not a number where it isn't held."""
        found = self.table.take(self._slot(keys).view(np.int64), axis=0)
        out = found[:, 1].copy().view(float)
        miss = np.flatnonzero(found[:, 0] != keys)
        out[miss] = np.nan
        if len(miss) and len(self.known):
            want = keys[miss]
            i = np.minimum(np.searchsorted(self.known, want), len(self.known) - 1)
            out[miss] = np.where(self.known[i] == want, self.known_log[i], np.nan)
        return out


def pair_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(pair, n): every (context, byte) pair of `docs` (text, train) and how often it occurs
    in the training texts (0: only other texts ask for it)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")  # sorted runs: merged
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, words in word_slices(batch.column(0)):
                padded, at, ends = canonical(words, depth)
                keys = gram_keys(padded, at, depth)
                counts = np.repeat(training[a:b], np.diff(ends))
                for part, learn in ((keys[counts], 1), (keys[~counts], 0)):
                    if len(part):
                        found, n = np.unique(part, return_counts=True)
                        held.append((found, n.astype(np.int64) * learn))
                if len(held) >= 8:
                    held = [merged()]
                    if len(held[0][0]) > 1_500_000:
                        yield from rows(*held.pop())
        if held:
            yield from rows(*merged())

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 65536].view(np.int64)), pa.array(n[a : a + 65536])], names=["pair", "n"])

    return docs.select(F.col("text").cast("string").alias("text"), "train").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _subtrees(pairs: DataFrame, depth: int, floor: int) -> DataFrame:
    """Rows of two kinds over (pair, n): a pair with what its subtree mixes (`below`, eight
    floats), and a root of a subtree (bit, name, ones, total, log_w)."""
    shift = np.uint64(64 - 8 * floor)
    fields = ["pair", "n", "below", "bit", "name", "ones", "total", "log_w"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, CHUNK

        def built(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            # whole subtrees only: rows are sorted, so the last one may go on
            own = np.ones(len(keys), bool) if last else (keys >> shift) != (keys[-1] >> shift)
            held, size = [(keys[~own], n[~own])], int((~own).sum())
            keys, n = keys[own], n[own]
            if not len(keys):
                return
            levels = subtree(keys, n, depth, floor)
            for a in range(0, len(keys), 65536):
                part = keys[a : a + 65536]
                below = partial(levels, part).astype(np.float32)
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(below.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(n[a : a + 65536]), column, *(pa.nulls(len(part), t) for t in (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=fields)
            for j, (names, ones, total, log_w) in enumerate(levels.roots):
                if len(names):
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(names), t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(np.full(len(names), j, np.int32)), pa.array(names.view(np.int64)), pa.array(ones), pa.array(total), pa.array(log_w)], names=fields)

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= limit:
                yield from built(False)
                limit = max(CHUNK, 2 * size)  # one subtree alone may be that large
        if size:
            yield from built(True)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = pairs.repartition(parts, F.shiftrightunsigned("pair", int(shift))).sortWithinPartitions("pair")
    return grouped.mapInArrow(run, "pair bigint, n bigint, below binary, bit int, name bigint, ones double, total double, log_w double")


def pair_scores(docs: DataFrame, depth: int = DEPTH, floor: int = FLOOR) -> DataFrame:
    """(pair, n, log): the model of the training texts of `docs` (text, train), as the log10
    probability of every pair that occurs in any text."""
    small_batches(docs.sparkSession)
    floor = min(floor, depth)
    mixed = saved(_subtrees(saved(pair_counts(docs, depth), "byte-pairs"), depth, floor), "subtrees")
    # the roots of the subtrees: a number that contexts of `floor` bytes bound
    tops = mixed.where("bit IS NOT NULL").select("bit", "name", "ones", "total", "log_w").toArrow()
    bit, names = tops["bit"].to_numpy(), tops["name"].to_numpy().view(np.uint64)
    columns = [tops[c].to_numpy() for c in ("ones", "total", "log_w")]
    roots = []
    for j in range(8):
        own = np.flatnonzero(bit == j)
        own = own[np.argsort(names[own])]
        roots.append((names[own], *(c[own] for c in columns)))
    shipped = docs.sparkSession.sparkContext.broadcast(Crown(roots, floor))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            below = text_buffer(batch.column(2))[0].view(np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shipped.value.log10(keys, below))], names=["pair", "n", "log"])

    return mixed.where("bit IS NULL").select("pair", "n", "below").mapInArrow(run, "pair bigint, n bigint, log double")
