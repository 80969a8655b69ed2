"""Ordinal quality classifier: a cumulative-link (proportional odds) model on hashed text.

Graded ratings 0..K-1 share one weight vector over hashed features; ordered
thresholds give ``P(grade >= k) = sigmoid(w.x - t_k)``, from which come the expected
grade and the tail probability used for selection.

Features (presence, hashed to ``2**bits``): each run of letters and digits and each
run of other signs, lower-cased; the first four and five bytes of longer runs; runs
in capitals.  Features that are rare in the sample or spread over the grades as the
whole sample is are left out, and weights are fitted by FTRL-proximal steps, whose L1
term keeps small weights at exactly zero, so that long clean texts are not judged by
noise.

Training takes at most ``sample`` labelled documents of together at most
``sample_bytes`` bytes (documented bounds: those with the least hash of their id, as far
as they fit); scoring covers every document.

Defined cases: null and empty texts have no features and get the prior; labels of
absent documents are ignored; a document with several labels trains with each, and an id
with several texts with each, as far as the bounds go; without labels every document
gets expected grade K-1 (nothing is known against it); very long texts are scored whole,
and train if they fit; equal texts get equal scores, ties of the tail are kept alike; an
empty table gives no rows; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, small_batches
from quillspark.llm.textkit import Words, mix64, slices, text_buffer

BITS = 20
SAMPLE = 20_000
SAMPLE_BYTES = 96 << 20

_classes = np.full(256, 2, np.uint8)
_classes[[0x20, *range(0x09, 0x0E)]] = 0
_classes[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_upper = np.zeros(256, np.int64)
_upper[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a slice, sorted."""
    words = Words(data, offsets, _classes)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, size = words.doc(), words.end - words.start
    found = [(doc, words.hashes(lower=True))]
    for k in (4, 5):
        longer = size > k
        found.append((doc[longer], mix64(words.hashes(lower=True, leading=k)[longer] + np.uint64(k))))
    capitals = np.r_[0, np.cumsum(_upper[words.data])]
    loud = (capitals[words.end] - capitals[words.start] == size) & (size > 1)
    found.append((doc[loud], np.full(int(loud.sum()), 0x5555555555555555, np.uint64)))
    shift = np.uint64(64 - bits)
    pairs = np.unique(np.concatenate([d.astype(np.uint64) << np.uint64(bits) | h >> shift for d, h in found]))
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Ordinal:
    """weights over hashed features; thresholds[k] parts grades k and k+1."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def _telling(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, size: int, least: int, deviation: float) -> list[np.ndarray]:
    """The rows without features of fewer than `least` documents, and without those whose
    grades are, at every cut, within `deviation` standard deviations of the whole sample's."""
    if not rows:
        return rows
    n, seen = np.zeros(size), np.zeros((n_grades - 1, size))
    for a in range(0, len(rows), 1000):
        flat = np.concatenate(rows[a : a + 1000])
        own = np.repeat(grades[a : a + 1000], [len(r) for r in rows[a : a + 1000]])
        n += np.bincount(flat, minlength=size)
        for k in range(1, n_grades):
            seen[k - 1] += np.bincount(flat[own >= k], minlength=size)
    keep = np.zeros(size, bool)
    for k in range(1, n_grades):
        share = (grades >= k).mean()
        keep |= np.abs(seen[k - 1] - n * share) > deviation * np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
    keep &= n >= least
    return [r[keep[r]] for r in rows]


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, *, epochs: int | None = None, batch: int = 64, alpha: float = 0.5, l1: float = 0.3, l2: float = 1.0, least: int = 3, deviation: float = 3.0) -> Ordinal:
    """FTRL-proximal on the cumulative log-likelihood in a fixed shuffled order; about 2000
    steps, and 6 passes at least."""
    epochs = epochs or max(6, min(60, 2000 * batch // max(len(rows), 1)))
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    cuts = np.array([np.log((np.sum(grades < k) + 1) / (np.sum(grades >= k) + 1)) for k in range(1, n_grades)])
    cuts = np.maximum.accumulate(cuts)
    rows = _telling(rows, grades, n_grades, size, least, deviation)
    order_of = np.random.default_rng(7)
    seen = np.zeros(n_grades - 1)
    for epoch in range(epochs):
        order = order_of.permutation(len(rows))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            feats = np.concatenate([rows[i] for i in own]) if len(own) else np.zeros(0, np.int64)
            if not len(feats):
                continue
            doc = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            used, inverse = np.unique(feats, return_inverse=True)
            zu = z[used]
            w = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((1.0 + np.sqrt(n[used])) / alpha + l2))
            score = np.bincount(doc, w[inverse], len(own))
            # the middle grades lie between two cuts: d log P / d score by the grade's two sides
            p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
            full = np.concatenate([np.ones((len(own), 1)), p, np.zeros((len(own), 1))], 1)
            slope = full * (1 - full)
            g = grades[own]
            mass = np.maximum(full[np.arange(len(own)), g] - full[np.arange(len(own)), g + 1], 1e-9)
            pull = (slope[np.arange(len(own)), g + 1] - slope[np.arange(len(own)), g]) / mass
            grad = np.bincount(inverse, pull[doc], len(used))
            sigma = (np.sqrt(n[used] + grad * grad) - np.sqrt(n[used])) / alpha
            z[used] += grad - sigma * w
            n[used] += grad * grad
            # -log P of a grade falls with its lower threshold and rises with its upper one
            pulls = np.zeros(n_grades + 1)
            np.add.at(pulls, g, slope[np.arange(len(own)), g] / mass)
            np.add.at(pulls, g + 1, -slope[np.arange(len(own)), g + 1] / mass)
            pulls = pulls[1:n_grades] / len(own)
            seen += pulls * pulls
            cuts = np.maximum.accumulate(cuts - 0.2 * pulls / np.sqrt(seen + 1e-8))
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))
    return Ordinal(weights.astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, *, n_grades: int, bits: int = BITS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Ordinal:
    """The model of `ratings` (doc_id, grade) over the texts of `docs`."""
    rated = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    # a threshold on the hash first, so that a partition keeps no more rows than its share of the sample
    place, rows = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), rated.count()
    most = (1 << 30) if rows <= sample else int((1 << 30) * min(1.0, 1.2 * sample / rows + 100 / rows))
    few = rated.where(place < most).orderBy(place, "doc_id", "grade").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most `sample` rows of two numbers: a proven bound for the broadcast
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(F.broadcast(few), "doc_id")
    sizes = sizes.groupBy("doc_id", "grade").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy(place, "doc_id", "grade")
    chosen, n_left, bytes_left = [], sample, sample_bytes
    for r in sizes.collect():
        if r["n"] <= n_left and r["size"] <= bytes_left:
            chosen.append((r["doc_id"], r["grade"]))
            n_left, bytes_left = n_left - r["n"], bytes_left - r["size"]
    picked = docs.sparkSession.createDataFrame(chosen, few.schema)
    labelled = texts.join(F.broadcast(picked), "doc_id").select("grade", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                doc, feature = features(data[part[0] : part[-1]], part - part[0], bits)
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))], names=["grade", "features"])

    got = labelled.mapInArrow(run, "grade int, features array<int>").toArrow()
    if not len(got):
        return Ordinal(np.zeros(1 << bits, np.float32), np.full(n_grades - 1, -40.0))
    lists = got["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    grades = got["grade"].to_numpy()
    order = np.lexsort((np.array([int(r.sum()) for r in rows]), np.diff(at), grades))  # not the order of arrival
    return fit([rows[i] for i in order], grades[order], n_grades, bits)


def score(docs: DataFrame, model: Ordinal, *, bits: int = BITS) -> DataFrame:
    """(doc_id, expected_grade, tails): tails[k-1] is P(grade >= k)."""
    return docs.select("doc_id", with_tails(docs.sparkSession, F.col("text"), model, bits).alias("tails")).select(
        "doc_id", F.aggregate("tails", F.lit(0.0), lambda a, b: a + b).alias("expected_grade"), "tails"
    )


def with_tails(spark, text: Column, model: Ordinal, bits: int = BITS) -> Column:
    """A column of the tail probabilities of `text`, as an Arrow-batched UDF."""
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def tails(texts: pa.Array) -> pa.Array:
        own = shipped.value
        out = []
        data, offsets = text_buffer(texts)
        for a, b in slices(offsets):
            part = offsets[a : b + 1]
            doc, feature = features(data[part[0] : part[-1]], part - part[0], bits)
            out.append(own.tails(np.bincount(doc, own.weights[feature], b - a)))
        k = len(own.thresholds)
        flat = np.concatenate(out).reshape(-1) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat))

    return tails(text.cast("string"))


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


KEEP_TAIL = 0.25


def select_documents(docs: DataFrame, labels: DataFrame, *, keep: float = KEEP_TAIL) -> tuple[DataFrame, Column]:
    """`docs` with a column of tail probabilities, and the condition to keep a row."""
    model = train(docs, graded(labels), n_grades=3)
    tails = fresh("_tails", docs)
    return docs.withColumn(tails, with_tails(docs.sparkSession, F.col("text"), model)), F.col(tails)[1] >= keep
