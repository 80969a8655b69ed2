"""Graph versions, schema healing and vector resizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.tables import state_of


def seed(spark: SparkSession, path: str) -> int:
    """The current version; the first call writes version 1."""
    if state_of(spark, path)[0][1]:
        return current(spark, path)
    spark.createDataFrame([(1,)], "graph_version int").withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(path)
    return 1


def current(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("graph_version")).first()[0]


def bump(spark: SparkSession, path: str) -> int:
    """Makes the next version current; readers that hold the old one keep reading it."""
    new = seed(spark, path) + 1
    spark.createDataFrame([(new,)], "graph_version int").withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(path)
    return new


def healed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` in the shape of `schema`: missing nullable columns are added, others must be there."""
    lacking = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if lacking:
        raise ValueError(f"columns that can't be added: {', '.join(lacking)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def resized(vectors: DataFrame, dim: int, truncate: bool = False) -> DataFrame:
    """Vectors of another size: emptied, or cut to it where `truncate` allows that."""
    if truncate:
        return vectors.where(F.size("embedding") >= dim).withColumn("embedding", F.slice("embedding", 1, dim))
    return vectors.where(F.size("embedding") == dim)
