"""Repeated passages by content-selected positions, the ground of two operators.

Any ``window`` consecutive words hold ``window - gram + 1`` word grams; the one with
the least hash (the rightmost of equals) is the window's *anchor*.  It depends on the
window's words alone, so two equal windows have equal anchors at equal places, and
only about one position in ``(window - gram) / 2`` is an anchor.  What is shuffled is
one row an anchor; windows whose anchor is unique in the corpus never leave the scan.

Anchors only propose.  What counts as equal is decided by the 128-bit BLAKE2b digest
of the word sequence (:func:`sequence_digests`), over word hashes that are injective
for words of up to eight bytes and digests of the bytes for longer ones.

A document is keyed by ``k = xxhash64(doc_id, text)``: equal rows share a key and
still count as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved
from quillspark.llm.textkit import gram_hashes, gram_valid, window_min, word_slices

_PLACE = np.uint64((1 << 24) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """(k, doc_id, text) of documents; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("k"), "doc_id", text.alias("text"))


class Runs:
    """The anchors of a slice: windows ``lo .. lo + size - 1`` have the gram at word
    ``place`` as their anchor, and `doc` is their document in the slice."""

    def __init__(self, words, window: int, gram: int) -> None:
        self.hashes = words.hashes()
        n = len(self.hashes)
        empty = np.zeros(0, np.int64)
        self.lo = self.size = self.place = self.doc = empty
        self.anchor = np.zeros(0, np.uint64)
        valid = gram_valid(words.first, n, window)
        at = np.flatnonzero(valid)
        if not len(at):
            return
        grams = gram_hashes(self.hashes, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = window_min((grams & ~_PLACE) | (_PLACE - (place & _PLACE)), window - gram + 1)[at]
        doc = words.doc()[at]
        new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
        start = np.flatnonzero(new)
        self.lo = at[start]
        self.size = np.diff(np.r_[start, len(at)])
        back = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
        # the place is known modulo 2**24 and lies within the window
        self.place = self.lo + ((back - self.lo) & int(_PLACE))
        self.anchor = grams[self.place]
        self.doc = doc[start]


def sequence_digests(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray | None = None) -> pa.Array:
    """Digest of the words lo..hi-1 for each pair, and of where the anchor lies in them (`skip`)."""
    raw = hashes.tobytes()
    if skip is None:
        found = b"".join(blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
    else:
        found = b"".join(blake2b(raw[8 * a : 8 * b], digest_size=16, salt=n.to_bytes(4, "little")).digest() for a, b, n in zip(lo.tolist(), hi.tolist(), skip.tolist(), strict=True))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(lo), [None, pa.py_buffer(found)]).cast(pa.binary())


def repeated_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, n): anchors that occur at two places or more, over (k, doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Runs(words, window, gram).anchor for _, _, words in word_slices(batch.column(0))]
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def occurrences(docs: DataFrame, window: int, gram: int, reach: int = 0, clip: bool = False) -> DataFrame:
    """(k, lo, size, place, h, ctx) of the repeated anchors: the runs of windows, word
    positions counted within the document.  ctx is the digest of all words of the run's
    windows; with `clip`, of the words within `reach` of the anchor's gram instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, words in word_slices(batch.column(1)):
                r = Runs(words, window, gram)
                first, last = words.first[r.doc], words.first[r.doc + 1]
                if clip:
                    lo, hi = np.maximum(r.place - reach, first), np.minimum(r.place + gram + reach, last)
                    ctx = sequence_digests(r.hashes, lo, hi, r.place - lo)
                else:
                    ctx = sequence_digests(r.hashes, r.lo, r.lo + r.size + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a + r.doc]), pa.array((r.lo - first).astype(np.int32)), pa.array(r.size.astype(np.int32)), pa.array((r.place - first).astype(np.int32)), pa.array(r.anchor.view(np.int64)), ctx],
                    names=["k", "lo", "size", "place", "h", "ctx"],
                )

    rows = docs.select("k", "text").mapInArrow(run, "k bigint, lo int, size int, place int, h bigint, ctx binary")
    # a table, so that both sides of the join are plain exchanges, which can be split where an anchor is hot
    return saved(rows.join(saved(repeated_anchors(docs, window, gram).select("h"), "anchors"), "h"), "occurrences")
