"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where that is unset, a temporary
    one on a single machine, and an error on a cluster, whose machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(lambda: _drop(_folders))


def remember(spark: SparkSession, path: str) -> None:
    """A folder to be deleted when the program ends."""
    _folders.append((spark, path))


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame of :func:`saved` that no later plan reads."""
    own = [t for t in _folders if t[1] == getattr(df, "_table", None)]
    _drop(own)
    _folders[:] = [t for t in _folders if t not in own]


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes what was saved within, at its end: for work whose result is written by then."""
    before = list(_folders)
    yield
    own = [t for t in _folders if t not in before]
    _drop(own)
    _folders[:] = before


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: its lineage ends
    there and the loss of an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def ranked(df: DataFrame, order: list, name: str, into: str = "g") -> DataFrame:
    """`df` as a table with the row's place (0, 1, ...) in the order of `order`.

    Range-partitioned, so that no key's rows have to share a task; only the number of
    rows of each partition comes to the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    placed = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_spot", local), name)
    part = F.shiftright("_spot", 33)
    sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = spark.createDataFrame(rows or [(0, 0)], "_p bigint, _before bigint")
    near = F.col("_spot").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == F.col("_p")).withColumn(into, F.col("_before") + near).drop("_spot", "_p", "_before")


@contextmanager
def few_samples(spark: SparkSession, rows: int = 20) -> Iterator[None]:
    """Range partitioning of wide keys with fewer samples a partition, as all of them go to the driver."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` documents, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def fresh(name: str, df: DataFrame) -> str:
    """A column name that `df` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str, modulus: int):
    """crc32 of an id written as text, modulo `modulus` (a null id gives null)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def binary_column(data: bytes, offsets) -> pa.Array:
    """A large_binary Arrow column over one buffer and n+1 int64 offsets, without copying each value."""
    import numpy as np

    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
