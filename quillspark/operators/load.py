"""A load of one act: volumes to staged sections, sections to a tree, references settled against
it, and the three tables and the log that a load leaves.

Phase A (`parse_volumes`) writes sections and definitions as a stage, one folder of JSON a
volume; phase B (`load_act`) reads the stage and does the rest in joins.  What the parts are
given may hold nulls and repeated rows: references without text or source drop out, repeated
rows of a payload collapse, an empty stage gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import reference_to_internal
from quillspark.operators.etl import salvaged, sectioned
from quillspark.operators.graph import pagerank
from quillspark.operators.ingest import extract, flatten
from quillspark.operators.normalise import normalised
from quillspark.operators.registry import used
from quillspark.operators.tables import publish, saved
from quillspark.sources import docx

# Fixed value: how a reference that names nothing is logged.
FAILED = "FAILED_NORMALIZATION"

STAGE = "volume string, ordinal int, level int, kind string, title string, content_md string"
RAW = "source_internal_id string, ordinal int, raw string, snippet string"


def write_stage(rows: DataFrame, folder: str) -> None:
    """The intermediate rows as JSON, a folder a volume; a volume that is parsed again replaces its own."""
    writer = rows.repartition("volume").sortWithinPartitions("volume", "ordinal").write.partitionBy("volume")
    writer.option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").mode("overwrite").json(folder)


def read_stage(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STAGE).json(folder)


def staged(spark: SparkSession, source: str) -> DataFrame:
    """Sections and definitions of the Word volumes under `source`."""
    blocks = saved(docx.read_blocks(spark, source))
    volume = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("volume")
    heads = docx.sections(blocks).select(volume, "ordinal", "level", sectioned(F.col("title"), F.col("level"))["kind"].alias("kind"), "title", "content_md")
    terms = docx.definitions(blocks).select(volume, "ordinal", F.lit(None).cast("int").alias("level"), F.lit("Definition").alias("kind"), F.col("term").alias("title"), F.col("text").alias("content_md"))
    return heads.union(terms)


def parse_volumes(spark: SparkSession, source: str, stage: str) -> None:
    """Phase A: the Word volumes under `source` as staged JSON."""
    write_stage(staged(spark, source), stage)


def definition_ref(act: Column, term: Column) -> Column:
    """ACT:Definition:term, where all that is no word or hyphen is one "_"."""
    return F.concat(act, F.lit(":Definition:"), F.regexp_replace(term, r"[^\w\-]+", "_"))


def tree(stage: DataFrame, act_id: str, deepest: int = max(docx.HEADINGS.values())) -> DataFrame:
    """Staged rows as nodes for `flatten`: a row's parent is the latest earlier one of its volume
    with a lesser level; a definition stands under the latest heading.  A volume is one file."""
    depth = F.coalesce("level", F.lit(deepest + 1))
    before = Window.partitionBy("volume").orderBy("ordinal", "kind").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(depth > k, F.last(F.when(F.col("level") == k, F.col("ordinal")), ignorenulls=True).over(before)) for k in range(deepest + 1)]
    head = sectioned(F.col("title"), F.col("level"))
    local = F.when(F.col("kind") != "Definition", head["local_id"])
    ref = F.when(F.col("kind") == "Definition", definition_ref(F.lit(act_id), F.col("title"))).when(local.isNotNull(), F.concat_ws(":", F.lit(act_id), "kind", local))
    return stage.withColumn("up", F.greatest(*latest)).select(
        F.concat_ws("#", "volume", "ordinal", F.when(F.col("kind") == "Definition", F.lit("d"))).alias("node_id"),
        F.when(F.col("up").isNotNull(), F.concat_ws("#", "volume", "up")).alias("parent_node_id"),
        F.col("volume").alias("batch"), "ordinal", ref.alias("ref_id"), F.col("kind").alias("type"), "title", "content_md",
    )


def registry(nodes: DataFrame) -> DataFrame:
    """(act, local_id, type) of the nodes that have a reference of three parts."""
    parts = F.split("ref_id", ":")
    return nodes.where(F.size(parts) == 3).select(parts[0].alias("act"), parts[2].alias("local_id"), parts[1].alias("type")).distinct()


def settle(nodes: DataFrame, raw: DataFrame, default_act: str) -> DataFrame:
    """(source_internal_id, source_ref_id, ordinal, original_ref_text, snippet, target_ref_id,
    target_id, target_internal_id): raw references (RAW) of nodes, normalised.  target_id is the
    name the target would have; target_internal_id is null where no such node is."""
    sources = nodes.select(F.col("internal_id").alias("source_internal_id"), F.col("ref_id").alias("source_ref_id"))
    named = raw.where("raw IS NOT NULL AND raw <> ''").join(sources, "source_internal_id")
    found = normalised(named, registry(nodes), default_act).withColumn("target_id", reference_to_internal(F.col("ref_id")))
    known = nodes.select(F.col("internal_id").alias("target_internal_id"))
    return found.join(known, found.target_id == known.target_internal_id, "left").select(
        "source_internal_id", "source_ref_id", "ordinal", F.col("raw").alias("original_ref_text"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.col("ref_id").alias("target_ref_id"), "target_id", "target_internal_id"
    )


def placeholders(settled: DataFrame, default_act: str) -> DataFrame:
    """(internal_id, ref_id, is_external): targets that the load lacks."""
    absent = settled.where("target_id IS NOT NULL AND target_internal_id IS NULL")
    return absent.groupBy(F.col("target_id").alias("internal_id")).agg(F.min("target_ref_id").alias("ref_id")).withColumn("is_external", ~F.col("ref_id").startswith(f"{default_act}:"))


def unresolved_log(settled: DataFrame, default_act: str) -> DataFrame:
    """(source_node_ref_id, original_reference, normalized_reference, snippet): every reference that
    names nothing, and the first use (by source, then place) of each missing target of the act."""
    row = [F.coalesce("source_ref_id", "source_internal_id").alias("source_node_ref_id"), F.col("original_ref_text").alias("original_reference"), F.coalesce("target_ref_id", F.lit(FAILED)).alias("normalized_reference"), "snippet"]
    failed = settled.where("target_id IS NULL").select(*row)
    absent = settled.where(F.col("target_internal_id").isNull() & F.col("target_ref_id").startswith(f"{default_act}:"))
    first = F.min_by(F.struct(*row), F.struct("source_internal_id", "ordinal", "original_ref_text", "snippet")).alias("r")
    return failed.union(absent.groupBy("target_id").agg(first).select("r.*"))


def write_log(log: DataFrame, folder: str) -> None:
    """The log as CSV with its header."""
    log.write.option("header", True).option("escape", '"').mode("overwrite").csv(folder)


def term_rows(nodes: DataFrame, uses: DataFrame, default_act: str) -> DataFrame:
    """(source_internal_id, term_text, definition_internal_id): used terms with their definition, if
    the load has it."""
    wanted = uses.where("term_text <> ''").select("source_internal_id", "term_text").distinct()
    known = nodes.select(F.col("internal_id").alias("definition_internal_id"))
    wanted = wanted.withColumn("_d", reference_to_internal(definition_ref(F.lit(default_act), F.col("term_text"))))
    return wanted.join(known, F.col("_d") == F.col("definition_internal_id"), "left").select("source_internal_id", "term_text", "definition_internal_id")


def terms_used(nodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(source_internal_id, term_text): terms of the dictionary (term) that a text holds or marks; what it marks at all
    where nothing is defined."""
    texts = nodes.select(F.col("internal_id").alias("id"), F.col("content_md").alias("text"))
    return used(texts, dictionary).select(F.col("id").alias("source_internal_id"), F.col("term").alias("term_text"))


@dataclass
class Payload:
    """What a load hands to the store."""

    provisions: DataFrame
    references: DataFrame
    terms: DataFrame
    log: DataFrame


def payloads(nodes: DataFrame, settled: DataFrame, uses: DataFrame, default_act: str, ranked: bool = True) -> Payload:
    """The tables of a load, each row once.  In-degree counts the other nodes that refer to a node,
    out-degree the distinct references it makes; `ranked` adds PageRank over nodes and
    placeholders alike.  Placeholders are no provisions."""
    edges = settled.where("target_id IS NOT NULL AND source_internal_id <> target_id").select(F.col("source_internal_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    into = edges.groupBy(F.col("dst").alias("internal_id")).agg(F.count("*").alias("in_degree"))
    out = settled.where("target_ref_id IS NOT NULL").groupBy(F.col("source_internal_id").alias("internal_id")).agg(F.countDistinct("target_ref_id").alias("out_degree"))
    rows = nodes.withColumns({"act_id": F.lit(default_act), "ref_id": F.coalesce("ref_id", "internal_id"), "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Unnamed Provision")), "content_md": F.coalesce("content_md", F.lit(""))})
    rows = rows.join(into, "internal_id", "left").join(out, "internal_id", "left").fillna(0, ["in_degree", "out_degree"])
    if ranked:
        every = nodes.select(F.col("internal_id").alias("id")).union(placeholders(settled, default_act).select("internal_id"))
        rows = rows.join(pagerank(every, edges).select(F.col("id").alias("internal_id"), F.col("rank").alias("pagerank")), "internal_id", "left")
    refs = settled.where("target_ref_id IS NOT NULL").select("source_internal_id", "target_ref_id", "target_internal_id", "original_ref_text", "snippet").distinct()
    return Payload(rows.dropDuplicates(["internal_id"]), refs, term_rows(nodes, uses, default_act), unresolved_log(settled, default_act))


def read_references(nodes: DataFrame, cache: DataFrame, model: str, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """Raw references (RAW) that a model finds in the nodes' texts, and the cache with its answers.
    A call is told the heading first."""
    told = nodes.select("internal_id", F.concat_ws("\n", F.concat(F.lit("# "), "ref_id", F.lit(" "), F.coalesce("title", F.lit(""))), F.coalesce("content_md", F.lit(""))).alias("text"))
    answers, grown = extract(told, cache, model, call)
    objects = F.posexplode(salvaged(F.col("response"), "ref_id string, snippet string")).alias("ordinal", "o")
    found = told.join(answers, "text").select(F.col("internal_id").alias("source_internal_id"), objects)
    return found.select("source_internal_id", "ordinal", F.col("o.ref_id").alias("raw"), F.col("o.snippet").alias("snippet")), grown


def usage(calls: DataFrame, input_price: float = 0.05, output_price: float = 0.2) -> DataFrame:
    """One row: tokens, cache hits, calls and cost (prices a million tokens) of model answers
    (input_tokens, output_tokens, cache_hit).  Tokens count for hits too; a call without tokens
    is none."""
    tokens = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    spent = (F.coalesce("input_tokens", F.lit(0)) > 0) | (F.coalesce("output_tokens", F.lit(0)) > 0)
    hit = F.coalesce("cache_hit", F.lit(False))
    out = calls.agg(*tokens, F.count_if(hit).alias("cache_hits"), F.count_if(~hit & spent).alias("api_calls"))
    return out.withColumn("cost", (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000)


def load_act(spark: SparkSession, stage: str, act_id: str, *, call: Callable[[str], str] | None = None, cache: DataFrame | None = None, model: str = "") -> Payload:
    """Phase B: a stage as the payload of an act.  Without `call` no references are read."""
    return payload_of(read_stage(spark, stage), act_id, call=call, cache=cache, model=model)


def payload_of(stage: DataFrame, act_id: str, *, call: Callable[[str], str] | None = None, cache: DataFrame | None = None, model: str = "") -> Payload:
    """:func:`load_act` over staged rows."""
    spark = stage.sparkSession
    nodes = saved(flatten(tree(stage, act_id)))
    raw = spark.createDataFrame([], RAW)
    if call is not None:
        empty = spark.createDataFrame([], "hash string, model string, response string")
        raw = read_references(nodes, empty if cache is None else cache, model, call)[0]
    defined = nodes.where("type = 'Definition'").select(F.col("title").alias("term"))
    return payloads(nodes, saved(settle(nodes, raw, act_id)), terms_used(nodes, defined), act_id)


def store(payload: Payload, folder: str, version: int, act_id: str) -> None:
    """A payload in the place of what an earlier run left for the same act and version."""
    owned = {"provisions": payload.provisions, "references": payload.references, "terms": payload.terms}
    for name, rows in owned.items():
        publish(rows.withColumn("act_id", F.lit(act_id)), f"{folder}/{name}", version)
    write_log(payload.log, f"{folder}/unresolved_internal_references_{act_id}")
