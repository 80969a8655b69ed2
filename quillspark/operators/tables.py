"""Intermediate and published tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is set, a temporary one on a single machine
    and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(lambda: _remove(_written))


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def folders(df: DataFrame, by: str, *order: str, spread: str | None = None) -> DataFrame:
    """`df` as a table with a folder for each value of the column `by`, sorted by `order` within.  Rows go to tasks by both; where
    one value of them may hold many rows, by `by` and a column `spread` with few values, which the table hasn't."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _written.append((spark, path))
    dealt = df.repartition(by, *order) if spread is None else df.repartition(by, spread)
    rows = dealt.sortWithinPartitions(by, *order) if spread is None else dealt.sortWithinPartitions(by, *order).drop(spread)
    rows.write.option("compression", "zstd").partitionBy(by).parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._table = path
    return out


def keyed(df: DataFrame, key: str, buckets: int = 64, order: tuple[str, ...] = (), spread: str | None = None) -> DataFrame:
    """`df` as a table in folders by the hash of `key` (``bucket``) and sorted by it and `order` within, so that a reader of
    some keys (see :func:`having`) opens their folders only, and of those the row groups that can hold them."""
    return folders(df.withColumn("bucket", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).cast("int")), "bucket", key, *order, spread=spread)


def having(table: DataFrame, key: str, values: list[str], buckets: int = 64) -> DataFrame:
    """The rows of a table of :func:`keyed` with these values of its key."""
    folders = sorted({crc32(v.encode()) % buckets for v in values})
    return table.where(F.col("bucket").isin(folders) & F.col(key).isin(values)) if values else table.where(F.lit(False))


def state_of(spark: SparkSession, *paths: str) -> tuple[tuple[int, int, int], ...]:
    """What tells one state of some tables from another: bytes, files and time of the last change of each; zeros where there is none."""
    out = []
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            out.append((0, 0, 0))
            continue
        size = fs.getContentSummary(target)
        out.append((size.getLength(), size.getFileCount(), fs.getFileStatus(target).getModificationTime()))
    return tuple(out)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of :func:`saved` that no later plan reads."""
    paths = {getattr(df, "_table", None) for df in frames}
    own = [t for t in _written if t[1] in paths]
    _remove(own)
    _written[:] = [t for t in _written if t not in own]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of `files` (path, digest) that the manifest lacks or has with another digest."""
    return files.join(manifest, ["path", "digest"], "left_anti")


def paired(files: DataFrame, manifest: DataFrame, done: DataFrame, first: int, last: int, pattern: str) -> DataFrame:
    """(name, digest, volume, target, due) of source files (name, digest): the files in the order of their names are the volumes
    `first`, `first` + 1, ... up to `last`, and further ones are left out.  `pattern` with the number of at least two digits for its {} is a
    volume's target.  A volume is due unless its target is among `done` (target) and the manifest (name, digest) has its file unchanged."""
    from quillspark.operators.ordering import ranked

    before, after = pattern.split("{}")
    rows = ranked(files.select("name", "digest").distinct(), [F.col("name"), F.col("digest")], "_place").withColumn("volume", (F.col("_place") + first).cast("int")).where(F.col("volume") <= last)
    rows = rows.withColumn("target", F.concat(F.lit(before), F.format_string("%02d", "volume"), F.lit(after)))
    same = manifest.select("name", "digest").distinct().withColumn("_same", F.lit(True))
    there = done.select("target").distinct().withColumn("_there", F.lit(True))
    due = ~(F.coalesce("_same", F.lit(False)) & F.coalesce("_there", F.lit(False)))
    return rows.join(same, ["name", "digest"], "left").join(there, "target", "left").select("name", "digest", "volume", "target", due.alias("due"))


def publish(df: DataFrame, path: str, version: int, partition: str = "act_id") -> None:
    """A version of a table, in the place of what an earlier run of that version left for the same
    partitions; other versions and partitions stay, and readers ask for theirs."""
    rows = df.withColumn("graph_version", F.lit(version))
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("graph_version", partition).mode("overwrite").parquet(path)


def purge(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key isn't in `gone`; rows without a key stay."""
    return df.join(gone.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct(), F.col(key) == F.col("_gone"), "left_anti")


def at_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("graph_version") == version)


class Kept:
    """Tables built once a version, of which the last `most` stay."""

    def __init__(self, build: Callable[[int], DataFrame], most: int = 2) -> None:
        self.build, self.most, self.tables = build, most, {}

    def at(self, version: int) -> DataFrame:
        if version not in self.tables:
            self.tables[version] = saved(self.build(version))
            while len(self.tables) > self.most:
                discard(self.tables.pop(next(iter(self.tables))))
        return self.tables[version]


class Fingerprints:
    """Stored fingerprints (seed, id, mass) by graph version: a read-through cache at `path`.

    Readers see one version only, so a bump of the version empties the cache; what is computed for it is
    appended.  Two writers of one seed write the same rows, which are read once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def at(self, version: int) -> DataFrame:
        if not state_of(self.spark, self.path)[0][1]:
            return self.spark.createDataFrame([], "seed string, id string, mass double")
        rows = at_version(self.spark, self.path, version)
        return rows.groupBy("seed", "id").agg(F.max("mass").alias("mass"))

    def add(self, rows: DataFrame, version: int) -> None:
        rows.select("seed", "id", "mass", F.lit(version).alias("graph_version")).write.mode("append").partitionBy("graph_version").parquet(self.path)

    def forget(self, before: int) -> None:
        """Deletes what versions before this one left."""
        held = [r["graph_version"] for r in self.spark.read.parquet(self.path).select("graph_version").distinct().collect()] if state_of(self.spark, self.path)[0][1] else []
        _remove([(self.spark, f"{self.path}/graph_version={v}") for v in held if v < before])
