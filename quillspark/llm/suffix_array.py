"""Passage deduplication with sparse suffix arrays.

A passage of ``window`` words or more that occurs at several places keeps one place.

1. Retain: of all suffixes only those at content-selected minimisers (the least of the
   ``gram``-word hashes of any ``window`` words) that occur twice or more are retained;
   a repeated passage has the same minimisers wherever it stands.
2. Collapse: suffixes that read the same for ``REACH`` words on both sides of their gram
   are one class.  All its members but the least (by document key and position) repeat
   that one and need no sorting.
3. Sort: one suffix a class is range-partitioned and sorted by its words (fixed-width
   word hashes, so byte order is word order), ties by document.  Ranges have no key in
   common, so a phrase in a third of all documents spreads over as many tasks as needed.
4. Compare and extend: neighbours in the order that share their gram are extended right
   and left, word by word.  With ``window`` words or more in common they match; the
   larger of the two places is a removable repeat of the smaller.  Runs of matching
   neighbours are also compared with the least place of their run.  The first and last
   suffix of every range go to a second, small comparison across the ranges.
5. Settle: a phrase that many texts hold parts suffixes whose common words lie to the
   left of it, so neighbours alone don't find all.  Where a gram has several readings,
   the windows anchored in it are counted by digest, one place a class, with partial sums;
   those that occur twice are repeats of their least place.  Equal windows have equal
   anchors, so with this every repeated window is found.

Every removed word has an equal word, in an equal passage, at a strictly smaller place,
so one copy of everything remains.

Defined cases: null and empty texts have no words and stay as they are; texts shorter
than the window stay; equal rows (one id, one text) share a key and keep or lose the same
words; very long texts are used whole; an empty table stays empty; extra columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import few_samples, fresh, saved, small_batches
from quillspark.llm.passages import keyed, occurrences, sequence_digests
from quillspark.llm.textkit import Words, slices, text_buffer

WINDOW = 50
GRAM = 20
REACH = 50


def _suffixes(chosen: DataFrame, gram: int, reach: int) -> DataFrame:
    """(h, right, left, k, place) for the classes' suffixes: word hashes of 8 bytes, 0 beyond the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            flat = lists.values
            spots, names = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                words = Words(data[part[0] : part[-1]], part - part[0])
                code = np.append(np.maximum(words.hashes(), np.uint64(1)), np.uint64(0))
                own = slice(int(at[a]), int(at[b]))
                doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                place = spots[own].astype(np.int64)
                first, last = words.first[doc], words.first[doc + 1]
                for c in range(0, len(place), 4000):
                    d = slice(c, c + 4000)
                    ahead = (first[d] + place[d])[:, None] + np.arange(gram + reach)[None, :]
                    ahead = np.where(ahead < last[d][:, None], ahead, len(code) - 1)
                    behind = (first[d] + place[d])[:, None] - 1 - np.arange(reach)[None, :]
                    behind = np.where(behind >= first[d][:, None], behind, len(code) - 1)
                    n = len(ahead)
                    right = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (gram + reach)), n, [None, pa.py_buffer(code[ahead].astype(">u8").tobytes())]).cast(pa.binary())
                    left = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * reach), n, [None, pa.py_buffer(code[behind].astype(">u8").tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(names[own][d]), right, left, pa.array(keys[a + doc[d]]), pa.array(place[d].astype(np.int32))], names=["h", "right", "left", "k", "place"])

    return chosen.mapInArrow(run, "h bigint, right binary, left binary, k bigint, place int")


def _windows(chosen: DataFrame, window: int) -> DataFrame:
    """(win, k, place): digests of the windows anchored in the classes' suffixes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            lows, sizes = (lists.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                words = Words(data[part[0] : part[-1]], part - part[0])
                own = slice(int(at[a]), int(at[b]))
                size = sizes[own]
                doc = np.repeat(np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), size)
                place = np.repeat(lows[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                at_word = words.first[doc] + place
                yield pa.RecordBatch.from_arrays([sequence_digests(words.hashes(), at_word, at_word + window), pa.array(keys[a + doc]), pa.array(place.astype(np.int32))], names=["win", "k", "place"])

    return chosen.mapInArrow(run, "win binary, k bigint, place int")


class _Block:
    """Consecutive suffixes of the sorted order."""

    def __init__(self, h, right, left, k, place) -> None:
        self.h, self.right, self.left, self.k, self.place = h, right, left, k, place

    def take(self, i) -> _Block:
        return _Block(self.h[i], self.right[i], self.left[i], self.k[i], self.place[i])

    @staticmethod
    def join(blocks: list[_Block]) -> _Block:
        return _Block(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("h", "right", "left", "k", "place")))

    @staticmethod
    def read(batch: pa.RecordBatch, gram: int, reach: int) -> _Block:
        def codes(col: pa.Array, n: int) -> np.ndarray:
            return text_buffer(col)[0].view(">u8").reshape(-1, n).astype(np.uint64)

        num = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
        return _Block(num(0), codes(batch.column(1), gram + reach), codes(batch.column(2), reach), num(3), num(4).astype(np.int64))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words two rows of codes share."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), same.shape[1], np.argmin(same, 1))


def _matches(block: _Block, i: np.ndarray, j: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Which of the pairs (i, j) share `window` words, and how far they do right and left."""
    r, left = _common(block.right[i], block.right[j]), _common(block.left[i], block.left[j])
    return (block.h[i] == block.h[j]) & (r + left >= window), r, left


def _compare(block: _Block, window: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Spans found in a block, and each suffix's index of the least place of its run."""
    n = len(block.h)
    i = np.arange(1, n)
    match, r, left = _matches(block, i - 1, i, window)
    pairs = [(i[match] - 1, i[match], r[match], left[match])]
    run_of = np.r_[0, np.cumsum(~match)]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((block.place, block.k))] = np.arange(n)
    starts = np.flatnonzero(np.r_[True, ~match])
    by_rank = np.argsort(rank)
    least = by_rank[np.minimum.reduceat(rank, starts)][run_of]
    far = np.flatnonzero((least != np.arange(n)) & (np.abs(least - np.arange(n)) > 1))
    if len(far):
        ok, r, left = _matches(block, least[far], far, window)
        pairs.append((least[far][ok], far[ok], r[ok], left[ok]))
    a, b, r, left = (np.concatenate(x) for x in zip(*pairs, strict=True))
    small, large = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
    both = np.r_[large, small]
    gone = np.r_[np.ones(len(large), bool), np.zeros(len(small), bool)]
    r, left = np.r_[r, r], np.r_[left, left]
    partner = np.r_[small, large]
    spans = [block.k[both], block.place[both] - left, block.place[both] + r, gone, block.k[partner]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["k", "start", "stop", "gone", "other"]), least


def _neighbours(suffixes: DataFrame, gram: int, reach: int, window: int) -> DataFrame:
    """Spans by comparison within each sorted range; its first and last suffix come along."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: _Block | None = None
        seen = 0
        raw_last: pa.RecordBatch | None = None

        def edge(row: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())]
            return pa.RecordBatch.from_arrays([row.column(3), *none, row.column(0), row.column(1), row.column(2), row.column(4)], names=out)

        out = ["k", "start", "stop", "gone", "other", "h", "right", "left", "place"]
        for batch in batches:
            if not len(batch):
                continue
            if not seen:
                yield edge(batch.slice(0, 1))
            seen += len(batch)
            raw_last = batch.slice(len(batch) - 1, 1)
            block = _Block.read(batch, gram, reach)
            if carry is not None:
                block = _Block.join([carry, block])
            spans, least = _compare(block, window)
            m = len(spans)
            yield pa.RecordBatch.from_arrays([*spans.columns, *(pa.nulls(m, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int32()))], names=out)
            tip = len(block.h) - 1
            carry = block.take(np.array([least[tip], tip] if least[tip] != tip else [tip]))
        if seen > 1:  # the only suffix of a range is no neighbour of itself
            yield edge(raw_last)

    return suffixes.mapInArrow(run, "k bigint, start bigint, stop bigint, gone boolean, other bigint, h bigint, right binary, left binary, place int")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """(k, start, stop, gone, other): word spans that occur elsewhere.  `gone` spans repeat
    one at a smaller place; `other` is the key of a document with the same passage."""
    spark = docs.sparkSession
    found = occurrences(docs, window, gram, reach, clip=True)
    classes = saved(found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k", "place", "lo", "size")).alias("one")), "readings")
    several = saved(classes.groupBy("h").agg(F.count("*").alias("readings")).where("readings > 1").select("h"), "several")
    # members of a class: they share `reach` words on both sides, where the texts have them
    many = classes.where("n > 1")
    members = found.join(many.select("h", "ctx", "one"), ["h", "ctx"])
    own = (F.col("k") == F.col("one.k")) & (F.col("place") == F.col("one.place"))
    wide = members.select("k", (F.col("place") - reach).alias("start"), (F.col("place") + gram + reach).alias("stop"), (~own).alias("gone"), F.col("one.k").alias("other"))
    spots = classes.join(several, "h", "left_semi").groupBy("one.k").agg(F.collect_list(F.struct(F.col("one.place").alias("place"), F.col("h"), F.col("one.lo").alias("lo"), F.col("one.size").alias("size"))).alias("spots"))
    # merged at every size, as in a corpus of which the candidates would never fit a broadcast
    chosen = saved(docs.select("k", "text").join(spots.hint("merge"), "k").select("k", "text", "spots"), "marked-texts")
    suffixes = _suffixes(chosen, gram, reach)
    order = ["h", "right", "k", "place"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    with few_samples(spark):
        compared = saved(_neighbours(ordered, gram, reach, window), "neighbours")
    # two suffixes a range: as many rows as there are tasks
    edges = compared.where(F.col("h").isNotNull()).select("h", "right", "left", "k", "place").coalesce(1).sortWithinPartitions(*order)
    across = _neighbours(edges, gram, reach, window)
    spans = compared.union(across).where(F.col("h").isNull()).select("k", "start", "stop", "gone", "other")
    wins = _windows(chosen, window)
    # a table, so that both sides of the join are plain exchanges, which can be split where a window is hot
    twice = saved(wins.groupBy("win").agg(F.count("*").alias("n"), F.min(F.struct("k", "place")).alias("least")).where("n > 1").select("win", "least"), "windows")
    settled = wins.join(twice.hint("merge"), "win").select("k", F.col("place").cast("long").alias("start"), (F.col("place") + window).cast("long").alias("stop"), (F.struct("k", "place") != F.col("least")).alias("gone"), F.col("least.k").alias("other"))
    spans = spans.union(settled)
    return spans.union(wide.select("k", F.col("start").cast("long"), F.col("stop").cast("long"), "gone", "other"))


def _union(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, **options: int) -> DataFrame:
    """One row for each document that shares a passage with another place: its repeated
    spans (word positions), how many words those hold, and how many repeat a smaller place."""
    small_batches(docs.sparkSession)
    plain = docs
    docs = keyed(docs)
    spans = repeated_spans(docs, **options).groupBy("k").agg(F.collect_set(F.struct("start", "stop", "gone")).alias("spans"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"doc_id": batch.column(0), "n_repeated": [], "n_removed": [], "passages": []}
            for words, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                start = np.maximum(np.array([s["start"] for s in found]), 0)
                stop = np.minimum(np.array([s["stop"] for s in found]), words)
                gone = np.array([s["gone"] for s in found])
                every, removed = _union(start, stop), _union(start[gone], stop[gone])
                rows["n_repeated"].append(sum(b - a for a, b in every))
                rows["n_removed"].append(sum(b - a for a, b in removed))
                rows["passages"].append([{"start": a, "stop": b} for a, b in every])
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(rows["n_repeated"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["passages"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=list(rows))

    sized = docs.select("k", "doc_id", F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("n_words")).join(spans, "k")
    return sized.select("doc_id", "n_words", "spans").mapInArrow(run, f"doc_id {kind}, n_repeated bigint, n_removed bigint, passages array<struct<start:bigint,stop:bigint>>")


def without_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` with every passage that repeats a smaller place cut out of `text`."""
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    spans = repeated_spans(keyed(docs), **options).where("gone").groupBy("k").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        lists = found.to_pylist()
        data, offsets = text_buffer(texts)
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            words = Words(data[part[0] : part[-1]], part - part[0])
            raw = data[part[0] : part[-1]].tobytes()
            for i in range(a, b):
                if not lists[i]:
                    continue
                x, y = int(words.first[i - a]), int(words.first[i - a + 1])
                begin, end = int(part[i - a] - part[0]), int(part[i - a + 1] - part[0])
                start = np.maximum(np.array([s["start"] for s in lists[i]]), 0)
                stop = np.minimum(np.array([s["stop"] for s in lists[i]]), y - x)
                pieces, at = [], begin
                for s, t in _union(start, stop):
                    pieces.append(raw[at : int(words.start[x + s])])
                    at = int(words.start[x + t]) if x + t < y else end
                out[i] = b"".join([*pieces, raw[at:end]]).decode()
        return pa.array(out, pa.string())

    k, own = fresh("_k", docs), fresh("_spans", docs)
    joined = docs.withColumn(k, key).join(spans.withColumnsRenamed({"k": k, "spans": own}).hint("merge"), k, "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(cut(F.col("text").cast("string"), F.col(own)))
    return joined.withColumn("text", text).select(*docs.columns)
