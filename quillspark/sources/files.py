"""Document folders, act configuration and media files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import media_segment, slug


# What ends a line, and what a page can show as an image.
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
SHOWN = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def read_documents(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(id, doc_type, title, body) of .json, .txt and .md files under `path`; empty bodies drop out.

    JSON files hold id, title, doc_type and body; what they lack comes from the file's name.  Of a text file
    the lines that aren't blank count, stripped: the first is its title and the others its body."""
    base = spark.read.option("recursiveFileLookup", "true")
    stem = F.regexp_replace("_metadata.file_name", r"(?<=.)\.[^.]*$", "").alias("stem")
    objects = base.option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(path, wholetext=True).select(stem, F.from_json("value", "id string, title string, doc_type string, body string").alias("o"))
    texts = base.option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").text(path, wholetext=True).select(stem, F.filter(F.transform(F.split("value", LINE_ENDS), _bare), lambda x: x != "").alias("lines"))

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(f"o.{name}"), F.lit("")), default).alias(name)

    one = objects.select(given("id", F.col("stem")), given("doc_type", F.lit("case")), given("title", F.translate("stem", "_", " ")), _bare(F.coalesce("o.body", F.lit(""))).alias("body"))
    two = texts.where("size(lines) > 1").select("stem", F.lit("case"), F.col("lines")[0], F.array_join(F.slice("lines", 2, F.size("lines")), "\n"))
    return one.union(two).where("body <> ''").select(slug(F.lit(dataset), F.col("id")).alias("id"), "doc_type", "title", "body")


def read_config(path: str | None = None, variable: str = "QUILLSPARK_CONFIG") -> dict:
    """The act configuration of `path`, or of the file that the environment names; empty without one."""
    path = path or os.environ.get(variable)
    if not path or not os.path.exists(path):
        return {"default_act": None, "acts": [], "datasets": []}
    with open(path, encoding="utf-8") as f:
        return {"default_act": None, "acts": [], "datasets": []} | json.load(f)


def exclusions(config: dict, act_id: str) -> list[str]:
    """Internal ids that an act's configuration keeps out of every search stage."""
    ids = next((a.get("exclusions", {}).get("ref_ids", []) for a in config["acts"] if a["id"] == act_id), [])
    return [i.replace(":", "_").replace("/", "_") for i in ids]


def without(nodes: DataFrame, excluded: list[str]) -> DataFrame:
    return nodes.where(~F.col("internal_id").isin(excluded)) if excluded else nodes


def media_format(column, extension):
    """Either "wmf" or "emf", by extension or leading bytes, else null."""
    ext = F.lower(F.regexp_replace(F.coalesce(extension, F.lit("")), r"^\.", ""))
    head = F.hex(F.substring(column, 1, 4))
    return (
        F.when(ext.isin("wmf", "emf"), ext)
        .when(head == "D7CDC69A", "wmf")
        .when(head.isin("01000900", "01000009"), "wmf")
        .when(F.hex(F.substring(column, 41, 4)) == "20454D46", "emf")
    )


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(digest, extension, format, content): distinct media files by content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rows = files.select(F.substring(F.sha1("content"), 1, 16).alias("digest"), F.lower(ext).alias("extension"), media_format(F.col("content"), ext).alias("format"), "content")
    return rows.dropDuplicates(["digest"])


def store_media(parsed: DataFrame, media: DataFrame, folder: str, act_id: str, convert: Callable[[bytes, str], bytes | None] | None = None) -> None:
    """The media (document, partname, content_type, content) of the documents of a load, each content once a document, in the place
    of all that an earlier load left for these documents (parsed: document), those without media included.

    `convert` makes a PNG of a metafile (its bytes, "wmf" or "emf") or None; the file's name tells what it was made from."""
    ext = F.lower(F.regexp_extract("partname", r"[^/](\.[^./]*)$", 1))
    kind = F.lower(F.element_at(F.split(F.coalesce("content_type", F.lit("")), "/"), -1))
    named = F.when(ext != "", ext).when(kind != "", F.concat(F.lit("."), kind)).otherwise("")
    rows = media.where("content IS NOT NULL").select(media_segment(F.col("document")).alias("document"), "partname", F.sha1("content").alias("digest"), named.alias("source"), media_format(F.col("content"), named).alias("format"), "content")
    once = rows.groupBy("document", "digest").agg(F.min(F.struct("partname", "source", "format")).alias("one"), F.any_value("content").alias("content"))
    flat = once.select("document", "digest", F.col("one.source").alias("source"), F.col("one.format").alias("format"), "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [convert(bytes(c), f) if f else None for c, f in zip(batch["content"], batch["format"], strict=True)]
            yield batch.assign(converted=[m is not None for m in made], content=[c if m is None else m for c, m in zip(batch["content"], made, strict=True)])

    flat = flat.withColumn("converted", F.lit(False)) if convert is None else flat.mapInPandas(run, "document string, digest string, source string, format string, content binary, converted boolean")
    stored = F.when(F.col("converted"), ".png").otherwise(F.coalesce(F.nullif("source", F.lit("")), F.lit(".bin")))
    act = media_segment(F.lit(act_id.lower()))
    told = flat.withColumn("extension", stored).withColumn("relative_path", F.concat_ws("/", act, "document", F.concat(F.substring("digest", 1, 16), F.col("extension"))))
    told = told.withColumn("renderable", F.col("converted") | F.col("extension").isin(SHOWN))
    # a document without media leaves a row without a digest, so that its folder is replaced too
    every = parsed.select(media_segment(F.col("document")).alias("document")).distinct().join(told, "document", "left").withColumn("act", act)
    every.write.option("partitionOverwriteMode", "dynamic").partitionBy("act", "document").mode("overwrite").parquet(folder)


def stored_media(spark: SparkSession, folder: str, base: str = "/media") -> DataFrame:
    """(act, document, digest, source, extension, relative_path, converted, renderable, public_url, content) of a folder of media."""
    rows = spark.read.parquet(folder).where("digest IS NOT NULL")
    url = F.when(F.col("renderable"), F.concat(F.lit("/" + (base.strip("/") or "media") + "/"), "relative_path"))
    return rows.select(F.col("act").cast("string"), F.col("document").cast("string"), "digest", "source", "extension", "relative_path", "converted", "renderable", url.alias("public_url"), "content")
