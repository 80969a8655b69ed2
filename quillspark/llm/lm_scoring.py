"""Corpus scoring: context-tree weighting beside a unigram base.

:func:`score_corpus` learns from the documents whose ``crc32(doc_id) mod 7`` is not
the held-out remainder and scores every document.  The unigram base needs the count
of every word of every text.  The counts are one table keyed by a 64-bit word hash;
its most frequent ``head`` words (a fixed bound) are broadcast and resolve almost
all tokens in the scan; the other tokens go through a shuffled join with the whole
table, so no word is dropped and nothing that is broadcast grows with the corpus.  The
(context, byte) pairs of the tree are looked up the same way: the most frequent
``head_pairs`` are broadcast, all others are joined.

Defined cases: null and empty texts hold the end token alone; a null id trains and
is not held out; repeated rows are scored each; very long texts are scored whole; ties
of frequency go to the joined side together; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, saved, small_batches
from quillspark.llm.context_tree import DEPTH, Scorer, canonical, gram_keys, pair_scores
from quillspark.llm.textkit import offsets_of, word_slices

HEAD = 400_000
HEAD_PAIRS = 1_600_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the lower-cased words of the column `text`; word is a 64-bit hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 65536].view(np.int64)), pa.array(counts[a : a + 65536])], names=["word", "n"])

        for batch in batches:
            for _, _, words in word_slices(batch.column(0)):
                new, n = np.unique(words.hashes(lower=True), return_counts=True)
                merged = np.concatenate([keys, new])
                order = np.argsort(merged)
                merged, total = merged[order], np.concatenate([counts, n])[order]
                first = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.zeros(0, int)
                keys, counts = merged[first], np.add.reduceat(total, first) if len(first) else total
                if len(keys) > 1_500_000:
                    yield from rows()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from rows()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the rows whose count `n` is at least 2**b, for the least b that leaves at most `most`."""
    counts = counts.where("n > 0")
    sizes = {r["b"]: r["m"] for r in counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).agg(F.count("*").alias("m")).collect()}
    least, kept = max(sizes, default=0) + 1, 0
    while least > 0 and kept + sizes.get(least - 1, 0) <= most:
        least -= 1
        kept += sizes.get(least, 0)
    got = counts.where(F.col("n") >= (1 << least)).select(key, value).toArrow()
    keys, values = got[key].to_numpy().view(np.uint64), got[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


class _Table:
    """Counts of the frequent words, by sorted keys and an index of their leading bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = np.arange(len(keys))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        i = self.slots[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.where(self.keys[i] == keys, self.counts[i], -1)
        again = np.flatnonzero(out < 0)
        i = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
        out[again] = np.where(self.keys[i] == keys[again], self.counts[i], -1)
        return out


def score_corpus(docs: DataFrame, *, depth: int = DEPTH, head: int = HEAD, head_pairs: int = HEAD_PAIRS, modulus: int = 7, held: int = 2) -> DataFrame:
    """One row a document: the contract's columns, with ``n_bytes`` of the canonical text and ``bits_per_byte``."""
    spark = docs.sparkSession
    small_batches(spark)
    out = F.coalesce(fold("doc_id", modulus) == held, F.lit(False))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), out.alias("held_out"))
    part = docs.where("NOT held_out")
    pairs = saved(pair_scores(docs.select("text", (~F.col("held_out")).alias("train")), depth), "pair-scores")
    counts = saved(word_counts(part), "word-counts")
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = part.count()
    n_all, v_all = totals["n"] + texts, totals["v"] + (texts > 0)
    shipped = spark.sparkContext.broadcast((frequent(counts, head, "word", "n"), frequent(pairs, head_pairs, "pair", "log")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(keys: np.ndarray, known: np.ndarray, first: np.ndarray) -> pa.Array:
        """The unknown keys of each document, of which `first` holds the places."""
        unknown = offsets_of(~known)
        return pa.ListArray.from_arrays(pa.array(unknown[first].astype(np.int32)), pa.array(keys[~known].view(np.int64)))

    def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[first[1:]] - total[first[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words_held, n_held), (pairs_held, logs_held) = shipped.value
        scorer, table = Scorer(pairs_held, logs_held), _Table(words_held, n_held)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for a, b, words in word_slices(batch.column(1)):
                padded, at, ends = canonical(words, depth)
                keys = gram_keys(padded, at, depth)
                logs = scorer(keys)
                sure = ~np.isnan(logs)
                hashes = words.hashes(lower=True)
                c = table.get(hashes)
                found = c >= 0
                hits = offsets_of(found)
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + m)),
                        batch.column(0).slice(a, m),
                        batch.column(2).slice(a, m),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(np.diff(hits[words.first]).astype(np.int64)),
                        pa.array(sums(np.where(found, np.log10(np.maximum(c, 0) + 1.0), 0.0), words.first)),
                        pa.array(sums(np.where(sure, logs, 0.0), ends)),
                        pa.array(np.diff(ends)),
                        lists(hashes, found, words.first),
                        lists(keys, sure, ends),
                    ],
                    names=["row", "doc_id", "held_out", "words", "known_words", "log_counts", "log_pairs", "n_bytes", "rare", "rare_pairs"],
                )
                row += m

    schema = f"row bigint, doc_id {kind}, held_out boolean, words bigint, known_words bigint, log_counts double, log_pairs double, n_bytes bigint, rare array<bigint>, rare_pairs array<bigint>"
    scored = saved(docs.mapInArrow(run, schema), "scored")
    rest = scored.select("row", F.explode("rare").alias("word")).join(counts.hint("merge"), "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    # merged at every size, as in a corpus of which the table would never fit a broadcast
    deep = scored.select("row", F.explode("rare_pairs").alias("pair")).join(pairs.select("pair", "log").hint("merge"), "pair").groupBy("row").agg(F.sum("log").alias("rare_pair_logs"))
    end = float(np.log10(texts + 1.0))
    every = float(np.log10(n_all + 1.0 * (v_all + 1)))
    none, zero = F.lit(0), F.lit(0.0)
    score = F.col("log_pairs") + F.coalesce("rare_pair_logs", zero)
    return scored.drop("rare", "rare_pairs").join(rest, "row", "left").join(deep, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known_words") + F.coalesce("rare_known", none) + int(texts > 0)).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("rare_logs", zero) + F.lit(end) - (F.col("words") + 1) * F.lit(every)).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (-score / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
