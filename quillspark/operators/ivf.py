"""Approximate nearest neighbours by inverted lists.

Centroids are trained with Spark's k-means on a bounded sample, every vector goes to the list of its
nearest centroid, and the lists are written in folders of their own, so that a search opens
only those it probes.  How many lists a query probes is settled when the index is built: the fewest that
reach the wanted recall for a bounded number of the base's own vectors, measured against all vectors.

A search takes its queries in broadcast blocks against the lists that any of them probes.  A task keeps the
k best of each query over all its batches, and only those are shuffled and merged.  Exact search is
:func:`quillspark.operators.vectors.nearest`."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.tables import folders
from quillspark.operators.vectors import QUERY_BLOCK

#: Bounds of what is trained and tuned on, whatever the base holds.
SAMPLE, TUNED = 20_000, 200
RECALL = 0.95


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table[column].combine_chunks()
    return np.asarray(values.flatten(), float).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _some(df: DataFrame, most: int) -> DataFrame:
    """About `most` rows, by the hash of their ids."""
    n = max(df.count(), 1)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    return df if n <= most else df.where(spread < int((1 << 20) * most / n)).limit(most)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0.0)


@dataclass
class Lists:
    """``rows`` (vec_id, embedding, list) in folders by list, the centroids, and how many lists a query probes."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    @staticmethod
    def build(base: DataFrame, lists: int | None = None, recall: float = RECALL, k: int = 10, seed: int = 7) -> Lists:
        """From (vec_id, embedding); by default as many lists as the root of the number of vectors, at most 4,096.
        Rows without a vector take no part."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        base = base.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        n = base.count()
        wanted = max(1, min(lists or int(n**0.5), 4096, n))
        sample = _some(base, SAMPLE).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
        centroids = np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(sample).clusterCenters()) if n > 1 else np.array([r["embedding"] for r in base.collect()] or np.zeros((0, 1)), float)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(pa.Table.from_batches([batch]), "embedding")
                nearest = np.concatenate([np.zeros(0, np.int64), *(np.argmin(_squares(x[a : a + 4096], centroids), axis=1) for a in range(0, len(x), 4096))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["vec_id", "embedding", "list"])

        rows = folders(base.mapInArrow(assign, "vec_id bigint, embedding array<float>, list int") if n else base.withColumn("list", F.lit(0)), "list")
        index = Lists(rows, centroids, len(centroids))
        index.probes = index._tuned(recall, k) if n else 0
        return index

    def _tuned(self, recall: float, k: int) -> int:
        """The fewest lists that hold the wanted share of the true neighbours of some of the vectors."""
        asked = _some(self.rows.select("vec_id", "embedding"), TUNED)
        true = self._search(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k, len(self.centroids))
        near = true.join(self.rows.select("vec_id", "list"), "vec_id").select("query_id", "list").toArrow()
        some = asked.toArrow()
        order = np.argsort(_squares(_matrix(some, "embedding"), self.centroids), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        at = {v: i for i, v in enumerate(some["vec_id"].to_pylist())}
        needed = np.sort([place[at[q], c] for q, c in zip(near["query_id"].to_pylist(), near["list"].to_pylist(), strict=True)])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, distance, sim, rank): about the k nearest others of each query (query_id, q)."""
        return self._search(queries.where("q IS NOT NULL"), k, min(probes or self.probes, max(len(self.centroids), 1)))

    def _search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        blocks = max(1, -(-2 * queries.count() // QUERY_BLOCK))
        parts = []
        for i in range(blocks):
            some = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).select("query_id", "q").toArrow()
            if len(some) and len(self.centroids):
                parts.append(self._block(some, k, probes))
        found = parts[0] if parts else queries.select("query_id", F.lit(None).cast("long").alias("vec_id"), F.lit(0.0).alias("distance")).where(F.lit(False))
        for p in parts[1:]:
            found = found.union(p)
        order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("query_id", "vec_id", "distance", (1 - F.col("distance") / 2).alias("sim"), "rank")

    def _block(self, some: pa.Table, k: int, probes: int) -> DataFrame:
        vectors, ids = _matrix(some, "q"), some["query_id"].to_numpy()
        nearest = np.argpartition(_squares(vectors, self.centroids), probes - 1, axis=1)[:, :probes]
        asking = {int(c): np.flatnonzero((nearest == c).any(1)) for c in np.unique(nearest)}
        shipped = self.rows.sparkSession.sparkContext.broadcast((vectors, ids, asking))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, ids, asking = shipped.value
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                x, rows, lists = _matrix(pa.Table.from_batches([batch]), "embedding"), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for c in np.unique(lists):
                    own, mine = asking[int(c)], np.flatnonzero(lists == c)
                    for a in range(0, len(mine), 4096):
                        part = mine[a : a + 4096]
                        d = np.sqrt(((vectors[own][:, None, :] - x[part][None, :, :]) ** 2).sum(2)) if len(own) * len(part) <= 1 << 14 else np.sqrt(_squares(vectors[own], x[part]))
                        d = np.where(ids[own][:, None] == rows[part][None, :], np.inf, d)
                        all_d = np.concatenate([best_d[own], d], axis=1)
                        all_i = np.concatenate([best_i[own], np.broadcast_to(rows[part], d.shape)], axis=1)
                        order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                        best_d[own], best_i[own] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            q, at = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, at]), pa.array(best_d[q, at])], names=["query_id", "vec_id", "distance"])

        return self.rows.where(F.col("list").isin(sorted(asking))).select("vec_id", "embedding", "list").mapInArrow(run, "query_id bigint, vec_id bigint, distance double")
