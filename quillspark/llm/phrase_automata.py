"""Removal of repeated phrases with sharded Aho-Corasick automata.

A window of ``window`` consecutive words is *recurring* if its word sequence also
starts at another place of the corpus (the same document included).  Every word
covered by a recurring window is removed; windows are judged on the input.

1. Confirm: anchors (see :mod:`passages`) that occur twice are joined with their
   occurrences.  Occurrences whose whole run of windows reads the same as another's
   are recurring outright; where an anchor has several readings, the windows of one
   occurrence of each are counted.  "The same" is the 128-bit digest of the word
   sequence.  Both counts are ordinary aggregations with map-side partial sums, so a
   phrase in a third of all documents is no hot task.
2. Compile: confirmed windows are routed to the documents that hold their anchor, and
   documents with any form shards, a bounded block of documents each.  A shard's
   automaton holds the windows routed to it, laid edge to edge over every recurring
   stretch; a pattern is a sequence of words, each numbered exactly by its bytes.
3. Stream: all documents of the shard run through its automaton, word by word, which
   locates every occurrence; the union of the matches is removed.  Documents without
   any repeated anchor can't hold a confirmed window and skip the automata.

Defined cases: null or empty texts have no words; texts shorter than a window keep
all; equal rows count as two places and return a row each; a null id is an id like
others; very long texts, and any number of distinct words, are windowed whole; ties (a
window at many places) are all removed; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, small_batches
from quillspark.llm.passages import keyed, occurrences, sequence_digests
from quillspark.llm.textkit import Words, slices, text_buffer

WINDOW = 35
GRAM = 8
SHARD_BYTES = 2 << 20


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and n+1 offsets of a list column; a null list is empty."""
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], column.type)
    at = column.offsets.to_numpy()
    return column.values.slice(int(at[0]), int(at[-1] - at[0])).to_numpy(zero_copy_only=False), at - at[0]


def _probe_windows(texts: DataFrame, window: int) -> DataFrame:
    """(k, place, win, weight): digests of the windows of the runs to be compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column(1))
            probes, at = _lists(batch.column(2))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                words = Words(data[part[0] : part[-1]], part - part[0])
                # a probe is lo, size, weight packed into one number
                own = probes[at[a] : at[b]].astype(np.uint64)
                doc = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                weight = (own & np.uint64(3)).astype(np.int64)
                size = (own >> np.uint64(2) & np.uint64((1 << 20) - 1)).astype(np.int64)
                lo = (own >> np.uint64(22)).astype(np.int64)
                many = np.repeat(np.arange(len(own)), size)
                place = lo[many] + np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size)
                at_word = words.first[doc[many]] + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a + doc[many]]), pa.array(place), sequence_digests(words.hashes(), at_word, at_word + window), pa.array(weight[many])],
                    names=["k", "place", "win", "weight"],
                )

    return texts.select("k", "text", "probes").mapInArrow(run, "k bigint, place bigint, win binary, weight bigint")


def _covered(codes: list[str], starts: list[np.ndarray], window: int, width: int = 1) -> list[np.ndarray]:
    """Word masks of the documents of one shard: compile its automaton, stream every document.

    codes: documents, `width` characters a word; starts: recurring windows routed to each."""
    automaton = ahocorasick.Automaton()
    for code, own in zip(codes, starts, strict=True):
        if not len(own):
            continue
        new = np.flatnonzero(np.r_[True, np.diff(own) > 1])
        for a, b in zip(own[new].tolist(), own[np.r_[new[1:], len(own)] - 1].tolist(), strict=True):
            for s in [*range(a, b, window), b]:
                automaton.add_word(code[s * width : (s + window) * width], True)
    out = []
    if len(automaton):
        automaton.make_automaton()
    for code in codes:
        change = np.zeros(len(code) // width + 1, np.int32)
        if len(automaton):
            ends = [e for e, _ in automaton.iter(code)]
            if ends:
                stop = np.array(ends) // width + 1
                np.add.at(change, stop - window, 1)
                np.add.at(change, stop, -1)
        out.append(np.cumsum(change[:-1]) > 0)
    return out


def _characters(code: np.ndarray) -> tuple[np.ndarray, int]:
    """Code points for word numbers, and how many a word takes: one, or from a million
    distinct words on two of unlike ranges, so that matches begin and end at words."""
    if not len(code) or int(code.max()) < 1_000_000:
        code = code.astype(np.uint32) + np.uint32(1)
        return np.where(code >= 0xD800, code + np.uint32(0x800), code).astype("<u4"), 1
    pairs = np.stack([(code >> 15) + 0x10000, (code & 0x7FFF) + 0x1000], 1)
    return pairs.astype("<u4").reshape(-1), 2


def _cut(located: DataFrame, window: int) -> DataFrame:
    """(k, n_words, n_removed, kept_sha256, kept) over (k, text, full, hits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            full, full_at = _lists(batch.column(2))
            hits, hits_at = _lists(batch.column(3))
            for a, b in slices(offsets, SHARD_BYTES):
                part = offsets[a : b + 1]
                words = Words(data[part[0] : part[-1]], part - part[0])
                points, width = _characters(words.codes())
                codes = [points[x * width : y * width].tobytes().decode("utf-32-le") for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                starts = []
                for i in range(a, b):
                    own = full[full_at[i] : full_at[i + 1]].astype(np.uint64)
                    lo, size = (own >> np.uint64(22)).astype(np.int64), (own >> np.uint64(2) & np.uint64((1 << 20) - 1)).astype(np.int64)
                    runs = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    starts.append(np.unique(np.concatenate([runs, hits[hits_at[i] : hits_at[i + 1]]]).astype(np.int64)))
                covered = _covered(codes, starts, window, width)
                raw = data[part[0] : part[-1]].tobytes()
                kept, removed, size = [], [], []
                for i in range(b - a):
                    text = raw[int(part[i] - part[0]) : int(part[i + 1] - part[0])].split()
                    kept.append(b" ".join(w for w, c in zip(text, covered[i].tolist(), strict=True) if not c))
                    removed.append(int(covered[i].sum()))
                    size.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                    names=["k", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return located.select("k", "text", "full", "hits").mapInArrow(run, "k bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def _plain(docs: DataFrame, with_text: bool) -> DataFrame:
    """(k, doc_id, n_words, sha256 of all words joined by one space[, those words])."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(2).to_pylist()]
            joined = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined]), *([pa.array([x.decode() for x in joined], pa.string())] if with_text else [])],
                names=["k", "doc_id", "all_words", "all_sha256", *(["all_text"] if with_text else [])],
            )

    return docs.mapInArrow(run, f"k bigint, doc_id {kind}, all_words bigint, all_sha256 string" + (", all_text string" if with_text else ""))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every document."""
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    found = occurrences(docs, window, gram)
    packed = lambda weight: F.shiftleft(F.col("lo").cast("long"), 22) + F.shiftleft(F.col("size").cast("long"), 2) + weight
    classes = saved(found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k", "lo", "size")).alias("one")), "readings")
    several = saved(classes.groupBy("h").agg(F.count("*").alias("readings")).where("readings > 1").select("h"), "several")
    whole = found.join(classes.where("n > 1").select("h", "ctx"), ["h", "ctx"], "left_semi")
    probes = classes.join(several, "h", "left_semi").select("one.*", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
    marks = whole.groupBy("k").agg(F.collect_set(packed(F.lit(0))).alias("full")).join(probes.groupBy("k").agg(F.collect_set(packed(F.col("weight"))).alias("probes")), "k", "full")
    texts = saved(docs.select("k", "text").join(marks, "k"), "marked-texts")

    wins = _probe_windows(texts.where(F.col("probes").isNotNull()), window)
    twice = wins.groupBy("win").agg(F.sum("weight").alias("n")).where("n > 1").select("win")
    hits = wins.where("weight = 1").join(twice, "win").groupBy("k").agg(F.collect_set("place").alias("hits"))
    located = texts.join(hits, "k", "left")
    cut = _cut(located, window)
    cut = cut if with_text else cut.drop("kept")
    cut = cut.dropDuplicates(["k"])
    return _plain(docs, with_text).join(cut, "k", "left").select(
        "doc_id",
        F.col("all_words").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
        *([F.coalesce("kept", "all_text").alias("kept")] if with_text else []),
    )
