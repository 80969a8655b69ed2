"""Vector operators over ARRAY<FLOAT> columns, with built-in array functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.operators.etl import embedding_cuts
from quillspark.operators.tables import upsert

Encoder = Callable[[list[str]], np.ndarray]


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


#: Twice the queries of a block, whose vectors every task gets; vectors that are compared with them at once.
QUERY_BLOCK, CHUNK = 4096, 1024


def nearest(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, sim, rank): the k nearest others of each query; one without a distance comes last.

    The queries are taken in blocks of about QUERY_BLOCK / 2, each compared with one
    scan of `base`, of which every task keeps its own k best before the final ranking."""
    blocks = max(1, -(-2 * queries.count() // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = _nearest_block(some, base, k)
        out = found if out is None else out.union(found)
    return out


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; one that is null, of another length or has a null in it is all NaN."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
    out = np.full((len(vectors), dim), np.nan)
    out[whole] = pc.list_flatten(vectors.filter(pa.array(whole))).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def _nearest_block(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Products of matrices bound every distance; what they leave among the k best is measured, component after component."""
    asked = queries.where("query_id IS NOT NULL").select("query_id", "q").toArrow().combine_chunks()
    shipped = queries.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        vectors = asked["q"].combine_chunks()
        dim = int(pc.max(pc.list_value_length(vectors)).as_py() or 0)
        q, names = _matrix(vectors, dim), asked["query_id"].to_numpy()
        squares = (q * q).sum(1)
        at, ids, far = np.zeros(0, np.int64), None, np.zeros(0)
        limit = np.full(len(q), np.inf)
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                own = batch.slice(first, CHUNK)
                b, others = _matrix(own.column(1), dim), own.column(0).to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    sums = squares[:, None] + (b * b).sum(1)
                    near = sums - 2 * (q @ b.T)
                    slack = 1e-9 * sums
                    if len(others) > k + 1:
                        # one of the k + 1 nearest may be the query itself
                        limit = np.fmin(limit, np.partition(near + slack, k, axis=1)[:, k])
                    row, col = np.nonzero(~(near - slack > limit[:, None]) & (names[:, None] != others))
                    gaps = np.zeros(len(row))
                    for j in range(dim):
                        gap = q[row, j] - b[col, j]
                        gaps += gap * gap
                at, far = np.r_[at, row], np.r_[far, np.sqrt(gaps)]
                ids = others[col] if ids is None else np.r_[ids, others[col]]
                order = np.lexsort((ids, far, at))  # NaN comes last
                at, ids, far = at[order], ids[order], far[order]
                start = np.searchsorted(at, np.arange(len(q) + 1))
                place = np.arange(len(at)) - start[at]
                full = np.flatnonzero(np.diff(start) >= k)
                worst = far[start[full] + k - 1] ** 2
                limit[full] = np.fmin(limit[full], worst + 1e-9 * worst)
                at, ids, far = at[place < k], ids[place < k], far[place < k]
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids), pa.array(far, mask=np.isnan(far))], names=["query_id", "vec_id", "distance"])

    kinds = [StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", base.schema["vec_id"].dataType), StructField("distance", DoubleType())]
    few = base.where("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, StructType(kinds))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    best = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "vec_id", "distance", (1 - F.col("distance") / 2).alias("sim"), "rank")


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, place, value): the mean vector of each group, scaled to unit length."""
    mean = vectors.select(key, F.posexplode("embedding").alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, key).select(key, "place", F.when(F.col("norm") > 0, F.col("m") / F.nullif("norm", F.lit(0.0))).otherwise(F.col("m")).alias("value"))


def hashed_words(dim: int = 64) -> Encoder:
    """An encoder without a model: counts of words by the CRC-32 of their bytes, signed."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            codes = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in text.lower().split()], np.int64)
            np.add.at(out[i], codes % dim, np.where(codes >> 31, 1.0, -1.0))
        return out

    return encode


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero ones stay."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def encoded(texts: DataFrame, load: Callable[[], Encoder], batch: int = 32, instruction: str | None = None) -> DataFrame:
    """`texts` (key, place, text) with vectors of unit length (zero ones stay).  `load` runs once a
    task and gives the model; an instruction is put in front of each text."""
    head = f"Instruct: {instruction}\nQuery:" if instruction else ""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for rows in batches:
            told = [head + (t or "") for t in rows["text"]]
            found = []
            for i in range(0, len(told), batch):
                found += list(_unit(np.asarray(encode(told[i : i + batch]), np.float32)))
            yield pd.DataFrame({"key": rows["key"].to_numpy(), "place": rows["place"].to_numpy(), "embedding": found})

    return texts.select("key", "place", "text").mapInPandas(run, "key string, place int, embedding array<float>")


def embed(p: DataFrame, load: Callable[[], Encoder], model: str, batch: int = 64, instruction: str | None = None) -> DataFrame:
    """Rows of the embeddings table for provisions: title and text in overlapping chunks, each
    encoded, their mean scaled to unit length.  One without text is encoded as an empty one; an instruction is
    put in front of each chunk.  `load` runs once a task and gives the model."""
    whole = F.concat_ws("\n", F.btrim(F.coalesce("title", F.lit(""))), F.btrim(F.coalesce("content_md", F.lit(""))))

    head = f"Instruct: {instruction}\nQuery:" if instruction else ""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for rows in batches:
            pieces = [(i, head + c) for i, chunks in enumerate(embedding_cuts(list(rows["text"]))) for c in chunks or [""]]
            sums = None
            for first in range(0, len(pieces), batch):
                own, told = zip(*pieces[first : first + batch], strict=True)
                v = _unit(np.asarray(encode(list(told)), np.float32)).astype(np.float64)
                sums = np.zeros((len(rows), v.shape[1])) if sums is None else sums
                np.add.at(sums, list(own), v)
            if sums is not None:
                yield pd.DataFrame({"entity_id": rows["key"].to_numpy(), "vector": list(_unit(sums).astype(np.float32))})

    # a text's chunks stay in its task, so only keys and texts are shuffled
    rows = p.where("internal_id IS NOT NULL").select(F.col("internal_id").alias("key"), whole.alias("text")).dropDuplicates(["key"]).mapInPandas(run, "entity_id string, vector array<float>")
    return rows.select(F.lit("provision").alias("entity_kind"), "entity_id", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector", F.lit(1.0).alias("l2_norm"))


def refresh(embeddings: DataFrame, p: DataFrame, load: Callable[[], Encoder], model: str) -> DataFrame:
    """The embeddings table after the provisions were embedded anew."""
    return upsert(embeddings, embed(p, load, model), ["entity_kind", "entity_id", "model"])
