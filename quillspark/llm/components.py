"""Connected components of an edge table, without collecting anything to the driver.

Alternates large-star and small-star steps until the edges are stars around each
component's least node (O(log n) rounds in practice).  A step is a partial minimum by
node and a join back, so a node with very many edges is pre-aggregated and its join
can be split.  Every round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node reachable."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        # large star: every larger neighbour of u moves to u's least neighbour
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours move to the least of them
        large = saved(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        last, now = now, saved(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(last)
        discard(large)
        if sign == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        sign = state
