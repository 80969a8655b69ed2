"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import saved


def ranked(df: DataFrame, order: list, into: str) -> DataFrame:
    """`df` with each row's place (0, 1, ...) in the order: range partitions, counted, then
    shifted by the rows before them.  Only one count a partition comes to the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id()))
    part = F.shiftright("_spot", 33)
    before, rows = 0, [(0, 0)]
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        rows.append((r["p"], before))
        before += r["count"]
    starts = spark.createDataFrame(rows[1:] or rows, "_p bigint, _before bigint")
    near = F.col("_spot").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == F.col("_p")).withColumn(into, F.col("_before") + near).drop("_spot", "_p", "_before")
