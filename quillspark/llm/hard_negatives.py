"""Hard-negative mining by product quantisation with stored residual norms.

Scores are integer inner products of quantised vectors.  Vectors are cut into subspaces of
``sub_dim`` components; each has a codebook (k-means, fitted on a bounded sample).  A row
stores its codes and, for each subspace, the norm of what the code leaves out, rounded
up.  For an anchor, the sum of its look-up tables at a row's codes is the score up to the
inner product with the residual, which by Cauchy and Schwarz is at most the sum of the
norms' products: a rigorous lower and upper bound of every score.  The sample decides how
tight the bounds are, never the result.

* Positives: rows of the anchor's label whose upper bound reaches the k-th best score are
  scored exactly; each task keeps its best, and so does the whole.
* Negatives: each positive opens a window of scores.  Rows of other labels whose bounds
  reach into it, above the k-th best score there, are scored exactly; likewise kept.

Anchors come in broadcast blocks of about ``ANCHORS`` (a fixed bound) against one scan of the
coded table each, in slabs of rows, so a task holds one slab and one block.

Defined cases: rows with a null label, a null vector, or a null, NaN or infinite component take no
part, nor do components beyond 2^20 in magnitude (whose scores would leave a long) or vectors of another
length than the most frequent one (the longer, in a tie); a null id is never an anchor and comes last in ties; repeated rows
are rows of their own (an anchor's copy can be its positive, and repeats its results); an anchor
without positives, or whose windows hold nothing, has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

SCALE = 256
SUB_DIM, CENTROIDS, SAMPLE = 2, 256, 16_384
ANCHORS, SLAB, TILE = 2048, 16_384, 128
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
_LIMIT = 1 << 20


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with integer components."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < _LIMIT)
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "label", "embedding").where(F.forall("embedding", fine))
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(scale * v.cast("double")).cast("int")).alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(size.select("d")), F.size("x") == F.col("d")).drop("d")


def lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from distinct rows spread over the sample; at most as many centres as distinct rows."""
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)]
    for _ in range(rounds):
        near = nearest_code(distinct, centres)
        weight = np.bincount(near, counts, len(centres))
        sums = np.stack([np.bincount(near, counts * distinct[:, i], len(centres)) for i in range(x.shape[1])], 1)
        centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1)[:, None], centres)
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        out[a : a + 4096] = np.argmin((centres**2).sum(1) - 2 * part @ centres.T, axis=1)
    return out


@dataclass
class Quantiser:
    """Codebooks of consecutive subspaces, each (codes, components)."""

    books: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, sub_dim: int = SUB_DIM, centroids: int = CENTROIDS) -> Quantiser:
        return Quantiser([lloyd(sample[:, i : i + sub_dim].astype(float), centroids) for i in range(0, sample.shape[1], sub_dim)])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(x.astype(float), at, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norms of the residuals (rounded up), one of each a subspace."""
        codes, norms = [], []
        for part, book in zip(self.parts(x), self.books, strict=True):
            near = nearest_code(part, book)
            codes.append(near)
            norms.append(np.sqrt(((part - book[near]) ** 2).sum(1)))
        return np.stack(codes, 1).astype(np.uint16), np.nextafter(np.stack(norms, 1).astype(np.float32), np.float32(np.inf))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of anchors (rows) and coded rows (columns)."""
        middle = np.zeros((len(codes), len(anchors)))
        spread = np.zeros((len(codes), len(anchors)))
        for i, (part, book) in enumerate(zip(self.parts(anchors), self.books, strict=True)):
            middle += (book @ part.T).take(codes[:, i], axis=0)
            spread += norms[:, i : i + 1] * np.sqrt((part**2).sum(1))
        spread += 1e-9 * np.abs(middle) + 1e-6 * (1 + spread)  # what rounding can add
        return np.ascontiguousarray((middle - spread).T), np.ascontiguousarray((middle + spread).T)


def _training(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, by the hash of the vector; the codebooks' fit needs no more."""
    n = max(rows.count(), 1)
    spread = F.pmod(F.xxhash64("x", "vec_id"), F.lit(1 << 20))
    some = rows if n <= most else rows.where(spread < int((1 << 20) * most / n))
    got = some.select("x").limit(most).toArrow()["x"].combine_chunks()
    return np.asarray(got.flatten()).reshape(len(got), -1) if len(got) else np.zeros((0, 0), np.int64)


def coded(rows: DataFrame, sub_dim: int = SUB_DIM, centroids: int = CENTROIDS, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser]:
    """(row, vec_id, label, x, codes, norms) as a table, with `row` a number of its own, and the quantiser."""
    rows = saved(rows, "vectors")
    quantiser = Quantiser.fit(_training(rows, sample), sub_dim, centroids)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(len(batch), -1)
            codes, norms = quantiser.encode(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (codes.astype(np.int32), norms)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(batch))), *batch.columns, *lists], names=["row", "vec_id", "label", "x", "codes", "norms"])
            row += len(batch)

    schema = f"row bigint, vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>, codes array<int>, norms array<float>"
    return saved(rows.select("vec_id", "label", "x").mapInArrow(run, schema), "coded"), quantiser


class _Slab:
    """Rows of the coded table with what their bounds need."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(parts).combine_chunks()
        matrix = lambda c: np.asarray(whole[c].combine_chunks().flatten()).reshape(len(whole), -1)
        self.row, self.label = whole["row"].to_numpy(), whole["label"].to_numpy()
        ids = whole["vec_id"]
        self.none, self.id = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        self.x, self.codes, self.norms = matrix("x").astype(np.int64), matrix("codes"), matrix("norms")


def _slabs(batches: Iterable[pa.RecordBatch]) -> Iterator[_Slab]:
    held, n = [], 0
    for batch in batches:
        for a in range(0, len(batch), SLAB):
            held.append(batch.slice(a, SLAB))
            n += len(held[-1])
            if n >= SLAB:
                yield _Slab(held)
                held, n = [], 0
    if n:
        yield _Slab(held)


class _Best:
    """The k best (score, id, row) seen, scores descending, then ids (nulls last), then rows."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.none, self.id, self.row = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return float(self.score[self.k - 1]) if len(self.score) >= self.k else -np.inf

    def add(self, score: np.ndarray, slab: _Slab, at: np.ndarray) -> None:
        if not len(at):
            return
        fields = [np.concatenate(p) for p in ((self.score, score), (self.none, slab.none[at]), (self.id, slab.id[at]), (self.row, slab.row[at]))]
        order = np.lexsort((fields[3], fields[2], fields[1], -fields[0]))[: self.k]
        self.score, self.none, self.id, self.row = (f[order] for f in fields)


def _search(vector: np.ndarray, slab: _Slab, among: np.ndarray, lower: np.ndarray, upper: np.ndarray, windows: list[tuple[float, float]], best: list[_Best]) -> None:
    """Adds to each window's best those of the rows `among` whose exact score lies within.

    A few rows near the top are scored first, so that the k-th best is known; then every row whose
    bounds allow a place among the best is."""
    lo, hi = lower[among], upper[among]
    for (least, most), kept in zip(windows, best, strict=True):
        open_to = np.flatnonzero((hi >= max(least, kept.least())) & (lo <= most))
        if not len(open_to):
            continue
        floor = max(least, kept.least())
        if len(open_to) > 4 * kept.k:
            middle = (lo[open_to] + hi[open_to]) / 2
            middle = np.where(middle <= most, middle, -np.inf)
            first = open_to[np.argpartition(-middle, 3 * kept.k)[: 3 * kept.k]]
            score = np.sort((slab.x[among[first]] @ vector))
            score = score[(score >= least) & (score <= most)]
            if len(score) >= kept.k:
                floor = max(floor, float(score[-kept.k]))
            open_to = open_to[hi[open_to] >= floor]
        score = slab.x[among[open_to]] @ vector
        inside = (score >= floor) & (score <= most)
        kept.add(score[inside], slab, among[open_to[inside]])


def _blocks(anchors: DataFrame, size: int) -> Iterator[pa.Table]:
    """The anchors in blocks of about `size`, by the hash of their row."""
    n = max(1, -(-anchors.count() // size))
    for i in range(n):
        got = (anchors if n == 1 else anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i)).toArrow()
        if len(got):
            yield got.combine_chunks()


def _matched(base: DataFrame, block: pa.Table, quantiser: Quantiser, k: int, same: bool) -> DataFrame:
    """(anchor_row, slot, row, id, score): each task's best `k` rows of each anchor and window."""
    column = lambda c: block[c].combine_chunks()
    x = np.asarray(column("x").flatten()).reshape(len(block), -1).astype(np.int64)
    windows = [[(-np.inf, np.inf)]] * len(block) if same else [[(w["least"], w["most"]) for w in ws] for ws in column("windows").to_pylist()]
    shipped = base.sparkSession.sparkContext.broadcast((x, column("row").to_numpy(), column("label").to_numpy(), windows, quantiser))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, rows, labels, windows, quantiser = shipped.value
        best = [[_Best(k) for _ in w] for w in windows]
        for slab in _slabs(batches):
            groups = {v: np.flatnonzero((slab.label == v) == same) for v in np.unique(labels)}
            for a in range(0, len(rows), TILE):
                lower, upper = quantiser.bounds(x[a : a + TILE], slab.codes, slab.norms)
                for i in range(a, min(a + TILE, len(rows))):
                    among = groups[labels[i]]
                    if same:
                        among = among[slab.row[among] != rows[i]]
                    _search(x[i], slab, among, lower[i - a], upper[i - a], windows[i], best[i])
        for i, slots in enumerate(best):
            for j, kept in enumerate(slots):
                if n := len(kept.score):
                    ids = pa.array(kept.id, mask=kept.none)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rows[i])), pa.array(np.full(n, j, np.int32)), pa.array(kept.row), ids, pa.array(kept.score)], names=["anchor_row", "slot", "row", "id", "score"])

    return base.select("row", "vec_id", "label", "x", "codes", "norms").mapInArrow(run, "anchor_row bigint, slot int, row bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def mine(vectors: DataFrame, anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = ANCHORS, sub_dim: int = SUB_DIM, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `vectors`
    (vec_id, label, embedding) that satisfy `anchor`: the first `negatives` rows of other labels whose
    score lies between `least` and `most` hundredths of the score of each of the first `positives` of its label."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    base, quantiser = coded(usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long")), sub_dim, centroids, sample)
    anchors = base.where(anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "x")
    found = [_matched(base, b, quantiser, positives, True) for b in _blocks(anchors, block)]
    if not found:
        return empty
    near = saved(_ranked(_all(found), positives).select(F.col("anchor_row").alias("row"), (F.col("rank") - 1).cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers between the hundredths; an empty window (a negative score) stays, so that slots keep their places
    hundredths = lambda n: F.expr(f"(({n}) - pmod({n}, 100)) div 100")
    window = F.struct((-hundredths(f"-{least} * positive_score")).alias("least"), hundredths(f"{most} * positive_score").alias("most"))
    windows = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", window.alias("w")))), lambda s: s["w"]).alias("windows"))
    asked = saved(anchors.join(windows, "row"), "windows")
    found = [_matched(base, b, quantiser, negatives, False) for b in _blocks(asked, block)]
    if not found:
        return empty
    best = _ranked(_all(found), negatives).select(F.col("anchor_row").alias("row"), "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(near, ["row", "slot"]).join(asked.select("row", "anchor_id"), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
