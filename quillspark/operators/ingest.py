"""Tree flattening, reference resolution and cached extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import path_label, reference_to_internal
from quillspark.operators.ordering import ranked
from quillspark.operators.tables import saved

# Fixed value: what a text must mention to be worth a model call.
MENTIONS = r"(?i)\b(section|division|part|schedule|act|\d{4})\b"


def flatten(nodes: DataFrame) -> DataFrame:
    """Provision rows of tree nodes (node_id, parent_node_id, batch, ordinal, ref_id, type, title,
    content_md): internal ids, paths and sibling order, level by level.

    Nodes without a ref id are named by their parent, title and a digest of their place,
    so the same tree always gives the same ids.  Roots count on over batches."""
    rows = ranked(nodes, [F.asc_nulls_first("parent_node_id"), F.asc("batch"), F.asc("ordinal"), F.asc("node_id")], "_at")
    first = rows.groupBy(F.col("parent_node_id").alias("_up")).agg(F.min("_at").alias("_first"))
    placed = rows.join(first, F.col("parent_node_id").eqNullSafe(F.col("_up"))).withColumn("sibling_order", (F.col("_at") - F.col("_first")).cast("int"))
    all_nodes = saved(placed.drop("_at", "_up", "_first"))
    front = all_nodes.where("parent_node_id IS NULL").withColumns({"parent_internal_id": F.lit(None).cast("string"), "parent_path": F.lit(None).cast("string"), "level": F.lit(1)})
    out = None
    while True:
        spot = F.substring(F.sha2(F.concat_ws("|", "node_id", "batch", "ordinal"), 256), 1, 12)
        unnamed = F.concat_ws("_", F.coalesce("parent_internal_id", F.lit("root")), F.lit("Element"), F.substring(F.regexp_replace("title", r"[^\w]+", "_"), 1, 80), spot)
        ref = F.nullif("ref_id", F.lit(""))
        named = front.withColumn("internal_id", F.coalesce(reference_to_internal(ref), unnamed)).withColumn("ref_id", F.coalesce(ref, "internal_id"))
        named = saved(named.withColumn("path", F.concat_ws(".", "parent_path", path_label(F.coalesce(F.element_at(F.split(ref, ":"), -1), "internal_id")))))
        out = named if out is None else out.union(named)
        up = named.select(F.col("node_id").alias("parent_node_id"), F.col("internal_id").alias("parent_internal_id"), F.col("path").alias("parent_path"), (F.col("level") + 1).alias("level"))
        front = all_nodes.join(up, "parent_node_id").select(*all_nodes.columns, "parent_internal_id", "parent_path", "level")
        if not front.limit(1).count():
            return out.drop("parent_path", "node_id", "parent_node_id", "batch", "ordinal").dropDuplicates(["internal_id"])


def resolve(refs: DataFrame, provisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (source_internal_id, target_ref_id, snippet) with their target, if it is a
    provision, and the log of those that aren't."""
    known = provisions.select(F.col("internal_id").alias("target_internal_id"), F.lit(True).alias("hit"))
    ready = refs.where("target_ref_id IS NOT NULL").dropDuplicates().withColumn("target_internal_id", reference_to_internal(F.col("target_ref_id")))
    joined = ready.join(known, "target_internal_id", "left")
    resolved = joined.select("source_internal_id", "target_ref_id", F.when(F.col("hit"), F.col("target_internal_id")).alias("target_internal_id"), "snippet")
    lost = joined.where("hit IS NULL").groupBy("source_internal_id", "target_ref_id").agg(F.count("*").alias("occurrences"), F.min("snippet").alias("snippet"))
    return resolved, lost


def extract(texts: DataFrame, cache: DataFrame, model: str, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(text, response) for texts worth a call, by a cache keyed by sha256 and model, and the
    cache with the new answers.  `call` runs once a distinct text that the cache lacks."""
    worth = texts.where((F.length("text") >= 10) & F.col("text").rlike(MENTIONS)).select("text", F.sha2("text", 256).alias("hash")).distinct()
    own = cache.where(F.col("model") == model).select("hash", "response")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"hash": batch["hash"], "model": model, "response": [call(t) for t in batch["text"]]})

    misses = worth.join(own, "hash", "left_anti")
    new = saved(misses.mapInPandas(run, "hash string, model string, response string"))
    every = own.union(new.select("hash", "response"))
    return worth.join(every, "hash").select("text", "response"), cache.select("hash", "model", "response").union(new)
