"""Corpus pipeline over `documents`: quality, near copies, repeated passages, leaks, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; each works on all that its
predecessor kept.

Defined cases, alike for every stage: a null text is treated as an empty one and stays
null; empty texts have no near copies, passages or leaks and are kept unless the
classifier rejects them; a null id is an id like others; very long texts are used whole;
of rows that are equal in id and text one stays; rows of one id with unlike texts are
documents of their own; ties go to the least id; empty tables give empty results; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import remember, scratch, shared_dir, table
from quillspark.llm.decontaminate import decontaminated
from quillspark.llm.jaccard_join import link_documents
from quillspark.llm.ordinal import select_documents
from quillspark.llm.packing import pack
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.suffix_array import without_repeats

# No stage's rows can be expressed in SQL as a whole (a trained classifier, suffix order, a tokenizer).
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on the labels, doesn't reject."""
    scored, keep = select_documents(docs, table(spark, sf_dir, "labels"))
    return scored.where(keep).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a row is known by its id and text, so that an id may stand for several texts
    groups = link_documents(docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(text).alias("sum")).alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id.doc_id", "doc_id.sum").distinct().withColumnsRenamed({"doc_id": "_first_id", "sum": "_first_sum"})
    kept = docs.join(first, docs["doc_id"].eqNullSafe(F.col("_first_id")) & (F.md5(text) == F.col("_first_sum")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand elsewhere too."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("passages", passages),
    ("leaks", leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
        remember(spark, path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
