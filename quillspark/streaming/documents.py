"""Continuous document ingestion: new files become chunks, each exactly once.

The source tracks the files it has read in its checkpoint; a micro-batch is written under
its own number, so a batch that is run again after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import chunks, slug, token_count


def chunk_rows(texts: DataFrame, dataset: str) -> DataFrame:
    """(document_id, chunk_index, text, token_count) of (path, value)."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = texts.where("trim(value) <> ''").select(slug(F.lit(dataset), stem).alias("document_id"), F.posexplode(chunks(F.col("value"))).alias("chunk_index", "text"))
    return rows.withColumn("token_count", token_count(F.col("text")))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, dataset: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a run over all files that are new under `source`; it ends when they are done."""
    lines = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length bigint, content binary").load(source)
    texts = lines.select("path", F.decode("content", "UTF-8").alias("value"))

    def write(batch: DataFrame, number: int) -> None:
        chunk_rows(batch, dataset).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's last batch."""
    every = spark.read.parquet(target)
    last = every.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["document_id", "batch"]).drop("batch")
