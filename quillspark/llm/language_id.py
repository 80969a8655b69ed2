"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points in lower case; every non-letter counts as one boundary
sign.  All 1- to 3-grams with a letter fall into ``2**bits`` buckets.  The counts of
each language cover all training documents; the matrix of log probabilities (buckets
by languages) is broadcast, and batches are scored in numpy: each n-gram of the batch
adds its bucket's row to its document.  A matrix holds at most ``LANGUAGES`` languages
(16 MB); where ``lang`` has more values, texts are scored by one matrix after another and
carry the best language so far, so no language is left out.

Learned from text and non-null ``lang`` of documents whose ``crc32(doc_id) mod 4`` is
not 2 only; the prediction sees the text alone.

Defined cases: null texts and texts without a letter give ``und`` with score 0; ties
go to the language that sorts first; with no training text all is ``und``; very long
texts are used whole; a null id trains; repeated rows count and score as rows; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, ranked, saved, small_batches
from quillspark.llm.textkit import slices, text_buffer

BITS = 14
ORDERS = 3
BOUNDARY = 32
LANGUAGES = 256


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each code point in lower case, or the boundary sign if it isn't a letter."""
    out = np.full(0x110000, BOUNDARY, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a slice, and the number of letters of each document."""
    starts = (data & 0xC0) != 0x80
    at = np.r_[0, np.cumsum(starts)][offsets]
    points = _folded()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    letter = points != BOUNDARY
    sums = np.r_[0, np.cumsum(letter)]
    letters = sums[at[1:]] - sums[at[:-1]]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(at))
    docs, buckets = [], []
    code = np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        m = len(points) - n + 1
        code = code[:m] * np.uint64(0x100000001B3) + (wide[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        good = (doc[:m] == doc[n - 1 :]) & (sums[n:] - sums[:m] > 0)
        mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        docs.append(doc[:m][good])
        buckets.append((mixed >> np.uint64(64 - bits)).astype(np.int64)[good])
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), letters
    return np.concatenate(docs), np.concatenate(buckets), letters


def counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n) over the texts of `docs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                doc, bucket, _ = ngrams(data[part[0] : part[-1]], part - part[0], bits)
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                own = code[doc]
                for first in range(0, len(names), LANGUAGES):
                    block = names[first : first + LANGUAGES]
                    inside = (own >= first) & (own < first + LANGUAGES) if len(names) > LANGUAGES else slice(None)
                    flat = np.bincount((own[inside].astype(np.int64) - first << bits) + bucket[inside], minlength=len(block) << bits)
                    for i, name in enumerate(block):
                        got = flat[i << bits : (i + 1) << bits]
                        total[str(name)] = total[str(name)] + got if str(name) in total else got
                    if len(total) > 2 * LANGUAGES:
                        yield from told()
        yield from told()

    part = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return part.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _matrix(rows: DataFrame, bits: int, alpha: float) -> tuple[list[str], np.ndarray]:
    """The languages of counts (lang, bucket, n), sorted, and their matrix."""
    # one row a language, its counts packed: at most 2**bits numbers each
    got = rows.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n")).orderBy("lang").collect()
    langs = [r["lang"] for r in got]
    table = np.zeros((1 << bits, len(langs)))
    for i, r in enumerate(got):
        table[np.fromiter(r["n"].keys(), np.int64), i] = np.fromiter(r["n"].values(), np.float64)
    matrix = np.log(table + alpha) - np.log(table.sum(0) + alpha * (1 << bits)) if langs else table
    return langs, matrix.astype(np.float32)


def train(docs: DataFrame, bits: int = BITS, alpha: float = 0.5, most: int = LANGUAGES) -> list[tuple[list[str], np.ndarray]]:
    """Languages and the matrix (bucket, language) of log probabilities, in blocks of at most `most` languages; priors are uniform."""
    small_batches(docs.sparkSession)
    counted = saved(counts(docs, bits), "language-counts")
    names = counted.select("lang").distinct()
    n = names.count()
    if n <= most:
        return [_matrix(counted, bits, alpha)]
    placed = saved(ranked(names, [F.col("lang")], "languages"), "language-places")
    return [_matrix(counted.join(placed.where(F.floor(F.col("g") / most) == k), "lang"), bits, alpha) for k in range(-(-n // most))]


def _logits(batch: pa.RecordBatch, at: int, table: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice a..b of the texts in column `at`: a, b, log probabilities (text, language) and the numbers of letters."""
    columns = [np.ascontiguousarray(table[:, k]) for k in range(table.shape[1])]
    data, offsets = text_buffer(batch.column(at))
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        doc, bucket, letters = ngrams(data[part[0] : part[-1]], part - part[0], bits)
        found = np.stack([np.bincount(doc, c[bucket], b - a) for c in columns], 1) if columns else np.zeros((b - a, 0))
        yield a, b, found, letters


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray]], *, bits: int = BITS) -> DataFrame:
    """(doc_id, lang_pred, score): the most probable language and its posterior."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if len(model) > 1:
        return _by_blocks(rows, model, kind, bits)
    shipped = docs.sparkSession.sparkContext.broadcast(model[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shipped.value
        for batch in batches:
            for a, b, logits, letters in _logits(batch, 1, table, bits):
                known = (letters > 0) & bool(names)
                if names:
                    best = logits.argmax(1)
                    score = 1 / np.exp(logits - logits.max(1, keepdims=True)).sum(1)
                    label = np.where(known, np.array(names, object)[best], "und")
                else:
                    label, score = np.full(b - a, "und", object), np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _by_blocks(rows: DataFrame, model: list[tuple[list[str], np.ndarray]], kind: str, bits: int) -> DataFrame:
    """:func:`predict` with a pass a block: a text carries its best language, that one's log probability and the sum of all
    probabilities against it."""
    schema = f"doc_id {kind}, text string, lang string, top double, total double"
    rows = rows.select("*", F.lit("und").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"))
    for k, block in enumerate(model):
        shipped = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, table = np.array(shipped.value[0], object), shipped.value[1]
            for batch in batches:
                old = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)]
                for a, b, logits, letters in _logits(batch, 1, table, bits):
                    lang, top, total = (o[a:b] for o in old)
                    high = logits.max(1)
                    least = np.maximum(high, top)
                    own = np.exp(logits - least[:, None]).sum(1)
                    # a tie stays with the earlier block, whose languages sort before
                    label = np.where((high > top) & (letters > 0), names[logits.argmax(1)], lang)
                    summed = np.where(letters > 0, total * np.exp(top - least) + own, 0.0)
                    columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(label, pa.string()), pa.array(least), pa.array(summed)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang", "top", "total"])

        rows = saved(rows.mapInArrow(run, schema), f"language-scores-{k}")
        shipped.destroy()
    return rows.select("doc_id", F.col("lang").alias("lang_pred"), F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, *, modulus: int = 4, held: int = 2, most: int = LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learnt from those that aren't held out."""
    model = train(docs.where(F.coalesce(fold("doc_id", modulus) != held, F.lit(True))), most=most)
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
