"""Vector best-fit packing: whole documents into sequences with several capacities.

A sequence has room for ``window`` tokens, ``max_docs`` documents and ``max_cost`` of attention
cost (the sum of squared lengths, what block-diagonal attention computes).  A document
longer than a sequence can take is cut into pieces of that length, the last one shorter;
nothing else is cut.

1. Documents are tokenised in the scan and their pieces written as a table.  A tokenizer of
   words treats what stands between blanks by itself, so the distinct runs of a
   batch are encoded once and gathered by number (Arrow's dictionary of the batch, and a
   bounded cache in the worker).
2. Pieces that fill a sequence have one of their own.  The others are dealt round-robin
   into blocks of about ``block`` pieces, as many as their number asks for, and each task packs one.
3. A block is packed by decreasing length.  Pieces of one length are the same vector
   (tokens, 1, length squared), so they are placed together: the open sequences that
   can take one under every capacity are ordered by the rule and filled in that order, which for the
   rule ``norm`` is exactly what one piece after another would do.  ``norm`` prefers the least
   weighted norm of what would be left, ``dot`` the largest weighted product of the piece with
   the direction of what is left.  A resource weighs by how much of it the block asks for,
   relative to the capacity (or by `weights`).

Each block leaves at most a few sequences partly filled, so their number stays near
the least possible at every size, and no task or driver sees more than a block.

Defined cases: a null or empty text is one end id; repeated rows are packed once per row; a
null id is carried like others; a very long text has as many pieces as it needs; the
strings of special tokens become those tokens; ties of the rule go to the older sequence; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, saved, small_batches
from quillspark.llm.textkit import offsets_of, slices, text_buffer

WINDOW, MAX_DOCS, END_ID = 2048, 2048, 0
BLOCK = 1 << 16
BLOCK_BYTES = 4 << 20
CACHED = 800_000


_ends = np.zeros(256, bool)
#: Signs that words end with; none is part of a special token's string or of an elision.
_ends[list(b".,;:!?*%$)")] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters by which a byte-level vocabulary shows the bytes.
_BYTES = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_shown))}


class WordEncoder:
    """Ids of a tokenizer that drops white space and never joins what stands on both sides of it.

    The runs between ASCII blanks are encoded by ``tokenizers``, each distinct one once.  To have fewer of
    them, what the tokenizer would do anyway is done for a whole block first: a blank goes
    between a letter and a sign (it cuts there), and a capital that no mark can follow is lowered.  A run of
    Latin letters is one word, so it goes to the merges without the normaliser.  At most `cached`
    runs, none over 40 characters, are kept for the next batch."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side
        from tokenizers import Tokenizer

        self.model, self.cached = Tokenizer.from_file(path), cached
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lowers = steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def words(self, runs: list[str]) -> list[list[int]]:
        """The ids of distinct runs."""
        out: list[list[int]] = [[]] * len(runs)
        other, merges = [], self.model.model
        for i, run in enumerate(runs):
            # letters up to U+024F are composed, and but for U+0130 have one lower letter
            if self.lowers and run.isalpha() and (run.isascii() or max(run) < "\u0250" and "\u0130" not in run):
                out[i] = [t.id for t in merges.tokenize(run.lower().encode().decode("latin-1").translate(_BYTES))]
            else:
                other.append(i)
        for i, e in zip(other, self.model.encode_batch_fast([runs[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def slots(self, runs: list[str]) -> np.ndarray:
        """The place of each of these distinct runs' ids in ``starts``."""
        if len(self.known) > self.cached:
            self.forget()
        found = np.array([self.known.get(r, -1) for r in runs], np.int64)
        new = np.flatnonzero(found < 0)
        names = [runs[i] for i in new.tolist()]
        lists = self.words(names)
        ends = offsets_of([len(x) for x in lists])
        base = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends[1:]])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1]))])
        found[new] = np.arange(base, base + len(new))
        self.known.update((name, base + k) for k, name in enumerate(names) if len(name) <= 40)
        return found

    def spaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with blanks before the signs that end words, and capitals lowered: the same ids, fewer distinct runs."""
        if not self.lowers or not len(data):
            return data, offsets
        text = data.tobytes()
        after = np.r_[data[1:], np.uint8(32)]
        before = np.r_[np.uint8(32), data[:-1]]
        if not any(s[:2] in text for s in self.special):
            data = np.where((data >= 65) & (data <= 90) & (after < 128), data + 32, data)
        accented = (np.r_[np.zeros(min(2, len(data)), np.uint8), data[:-2]] == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 128)
        at = np.flatnonzero(_ends[data] & (_letter[before] | accented))
        return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in a row, and each text's place among them (n+1)."""
        data, offsets = self.spaced(*text_buffer(texts))
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))))
        runs = split.flatten().dictionary_encode()
        slots = self.slots(runs.dictionary.to_pylist())
        use = slots[runs.indices.to_numpy()] if len(runs) else np.zeros(0, np.int64)
        sizes = (self.starts[1:] - self.starts[:-1])[use]
        ends = offsets_of(sizes)
        ids = self.flat[np.repeat(self.starts[use] - ends[:-1], sizes) + np.arange(ends[-1])]
        first = np.asarray(split.offsets).astype(np.int64)
        return ids, ends[first - first[0]]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def best_fit(lengths: np.ndarray, window: int = WINDOW, max_docs: int = MAX_DOCS, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces of these lengths, by decreasing length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    lengths = np.asarray(lengths, np.int64)
    capacity = np.array([window, max_docs, window * window if max_cost is None else max_cost], np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    demand = np.array([lengths.sum(), len(lengths), (lengths.astype(float) ** 2).sum()])
    weight = demand / capacity if weights is None else np.asarray(weights, float)
    order = np.argsort(-lengths, kind="stable")
    values, first = np.unique(-lengths[order], return_index=True)
    bounds = [*first.tolist(), len(lengths)]
    left, number = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    opened = 0
    for size, a, b in zip((-values).tolist(), bounds[:-1], bounds[1:], strict=True):
        item = np.array([size, 1, size * size], np.int64)
        if (item > capacity).any():
            raise ValueError(f"a piece of {size} tokens is over a sequence's capacity")
        todo = b - a
        fits = np.flatnonzero((left >= item).all(1))
        if len(fits):
            if rule == "norm":
                score = (weight * (((left[fits] - item) / capacity) ** 2)).sum(1)
            else:
                rest = left[fits] / capacity
                score = -(weight * rest * (item / capacity)).sum(1) / np.sqrt((weight * rest**2).sum(1))
            if len(fits) > todo:  # each takes one at least
                near = np.argpartition(score, todo - 1)[:todo]
                near = np.flatnonzero(score <= score[near].max())
                fits, score = fits[near], score[near]
            fits = fits[np.lexsort((number[fits], score))]
            room = (left[fits] // item).min(1)
            taken = np.minimum(room, np.maximum(todo - (np.cumsum(room) - room), 0))
            some = taken > 0
            fits, taken = fits[some], taken[some]
        else:
            taken = np.zeros(0, np.int64)
        more = todo - int(taken.sum())
        if more:
            each = int((capacity // item).min())
            n = -(-more // each)
            fits = np.concatenate([fits, np.arange(len(left), len(left) + n)])
            taken = np.concatenate([taken, np.full(n, each)])
            taken[-1] = more - (n - 1) * each
            left = np.concatenate([left, np.tile(capacity, (n, 1))])
            number = np.concatenate([number, np.arange(opened, opened + n)])
            opened += n
        at = np.repeat(np.arange(len(fits)), taken)
        nth = np.arange(todo) - np.repeat(np.cumsum(taken) - taken, taken)
        own = order[a:b]
        bins[own] = number[fits[at]]
        offsets[own] = window - left[fits[at], 0] + nth * size
        left[fits] -= taken[:, None] * item
        full = left.min(1) <= 0
        if full.sum() * 4 > len(left):
            left, number = left[~full], number[~full]
    return bins, offsets


def document_pieces(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(k, doc_id, piece, start, length, ids_crc32[, ids]): the pieces of all documents."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        context = TaskContext.get()
        k = (context.partitionId() if context else 0) << 36
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for s, e in slices(offsets, BLOCK_BYTES):
                got, first = encode(pc.fill_null(batch.column(1).slice(s, e - s).cast(pa.large_string()), ""))
                sizes = np.diff(first) + 1
                ends = offsets_of(sizes)
                ids = np.full(ends[-1], end_id, "<u4")
                ids[np.arange(len(got)) + np.repeat(np.arange(e - s), sizes - 1)] = got
                n = -(-sizes // window)
                doc = np.repeat(np.arange(e - s), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * window
                length = np.minimum(window, sizes[doc] - start)
                data = memoryview(ids.tobytes())
                at = 4 * offsets_of(length)
                crc = np.fromiter((zlib.crc32(data[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(doc))
                out = {
                    "k": pa.array(np.arange(k, k + len(doc))),
                    "doc_id": batch.column(0).slice(s, e - s).take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc),
                }
                if with_ids:
                    out["ids"] = binary_column(data, at)
                k += len(doc)
                yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, f"k bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def pack_vectors(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, max_docs: int = MAX_DOCS, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] | None = None, end_id: int = END_ID, block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """One row a piece: ``doc_id``, ``piece``, ``start`` among the document's ids, ``length``, ``ids_crc32``
    (and ``ids``, little-endian unsigned 32-bit), its ``sequence_id`` and ``offset`` there."""
    if max_docs < 1 or max_cost is not None and max_cost < 1:
        raise ValueError("a sequence must have room for a document")
    longest = min(window, isqrt(max_cost) if max_cost is not None else window)
    rows = saved(document_pieces(docs, tokenizer, window=longest, end_id=end_id, with_ids=with_ids), "pieces")
    alone = F.col("length") == window
    blocks = max(1, -(-rows.where(~alone).count() // block))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        keys = pa.concat_arrays([b.column(0) for b in held])
        lengths = np.concatenate([b.column(1).to_numpy() for b in held])
        bins, offsets = best_fit(lengths, window, max_docs, max_cost, rule, weights)
        context = TaskContext.get()
        number = 2 * (bins + ((context.partitionId() if context else 0) << 32))
        yield pa.RecordBatch.from_arrays([keys, pa.array(number), pa.array(offsets)], names=["k", "sequence_id", "offset"])

    placed = rows.where(~alone).select("k", "length").repartition(blocks).mapInArrow(run, "k bigint, sequence_id bigint, offset bigint")
    out = rows.where(~alone).join(placed, "k").select(*rows.columns, "sequence_id", "offset")
    return out.union(rows.where(alone).select(*rows.columns, (2 * F.col("k") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))).drop("k")
