"""The engine's tables, and adapters that read them from the star-schema fixtures.

Acts are regions; the provision tree is region, nation, customer, order, with suppliers
as definitions under their nation.  Orders cite the suppliers of their line items
(supplier keys that end in 0 are external) and use part names as terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """internal_id, act_id, ref_id, type, local_id, title, content_md, level, path,
    parent_internal_id, sibling_order."""
    region, nation, customer, supplier, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    n = F.broadcast(nation.select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("act"), F.concat(F.lit("R"), "n_regionkey", F.lit("_N"), "n_nationkey").alias("up")))
    c = customer.join(n, customer.c_nationkey == n.n_nationkey)
    s = supplier.join(n, supplier.s_nationkey == n.n_nationkey)
    who = c.select("c_custkey", "act", F.concat("up", F.lit("_C"), "c_custkey").alias("up"))
    o = orders.join(who, orders.o_custkey == who.c_custkey)

    def rows(df: DataFrame, kind: str, key: str, prefix: str, level: int, title, content, parent=None) -> DataFrame:
        own = F.concat(F.col("up"), F.lit(f"_{prefix}"), F.col(key)) if parent else F.concat(F.lit(prefix), F.col(key))
        act = F.col("act") if parent else own
        local = F.lower(title) if kind == "Definition" else F.col(key).cast("string")
        return df.select(
            own.alias("internal_id"),
            act.alias("act_id"),
            F.concat(act, F.lit(f":{kind}:"), local).alias("ref_id"),
            F.lit(kind).alias("type"),
            local.alias("local_id"),
            title.alias("title"),
            content.alias("content_md"),
            F.lit(level).alias("level"),
            F.translate(own, "_", ".").alias("path"),
            (F.col("up") if parent else F.lit(None).cast("string")).alias("parent_internal_id"),
            F.col(key).cast("long").alias("key"),
        )

    division = nation.select("n_nationkey", "n_name", F.concat(F.lit("R"), "n_regionkey").alias("act"), F.concat(F.lit("R"), "n_regionkey").alias("up"))
    every = (
        rows(region, "Act", "r_regionkey", "R", 1, F.col("r_name"), F.concat(F.lit("# "), "r_name"))
        .union(rows(division, "Division", "n_nationkey", "N", 2, F.col("n_name"), F.concat(F.lit("Division of *"), "n_name", F.lit("*")), True))
        .union(rows(c, "Section", "c_custkey", "C", 3, F.col("c_name"), F.concat(F.lit("Segment "), "c_mktsegment"), True))
        .union(rows(s, "Definition", "s_suppkey", "S", 3, F.col("s_name"), F.concat(F.lit("**"), "s_name", F.lit("** means a supplier.\n\nSee section 6-5.")), True))
        .union(rows(o, "Paragraph", "o_orderkey", "O", 4, F.concat(F.lit("Order "), "o_orderkey"), F.concat(F.lit("Priority "), "o_orderpriority", F.lit(" status "), "o_orderstatus"), True))
    )
    # nations have few children of a kind, so siblings are numbered within their parent
    order = Window.partitionBy("parent_internal_id").orderBy("type", "key")
    return every.withColumn("sibling_order", (F.row_number().over(order) - 1).cast("int")).drop("key")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(okey, source_internal_id): orders by key."""
    p = provisions(spark, sf_dir)
    return p.where("type = 'Paragraph'").select(F.col("local_id").cast("long").alias("okey"), F.col("internal_id").alias("source_internal_id"))


def _suppliers(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """`df` (l_suppkey) with the rid and tid of its suppliers.  The tables are joined one by one, each with a size that
    Spark knows, so suppliers are broadcast as long as they are few, and the ids are made of what the join found."""
    supplier, nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), table(spark, sf_dir, "nation")
    n = F.broadcast(nation.select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("_act"), F.concat(F.lit("R"), "n_regionkey", F.lit("_N"), "n_nationkey").alias("_up")))
    joined = df.join(supplier, df.l_suppkey == supplier.s_suppkey).join(n, supplier.s_nationkey == n.n_nationkey)
    return joined.select(*df.columns, F.concat("_act", F.lit(":Definition:"), F.lower("s_name")).alias("rid"), F.concat("_up", F.lit("_S"), "s_suppkey").alias("tid"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_internal_id, target_ref_id, target_internal_id (null: external), snippet."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    source = _sources(spark, sf_dir)
    outside = F.col("l_suppkey") % 10 == 0
    return _suppliers(item.join(source, item.l_orderkey == source.okey), spark, sf_dir).select(
        "source_internal_id",
        F.when(outside, F.concat(F.lit("EXT:Act:"), "l_suppkey")).otherwise(F.col("rid")).alias("target_ref_id"),
        F.when(~outside, F.col("tid")).alias("target_internal_id"),
        F.concat("l_returnflag", "l_linestatus").alias("snippet"),
    )


def term_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_internal_id, term_text, definition_internal_id; one row a (source, term)."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("term_text"))
    source = _sources(spark, sf_dir)
    named = item.join(part, item.l_partkey == part.p_partkey).select("l_orderkey", "l_suppkey", "term_text")
    # an id holds its order's key, so lines that were dealt by it are grouped where they are
    used = _suppliers(named.join(source, named.l_orderkey == source.okey), spark, sf_dir)
    grouped = used.groupBy("okey", "source_internal_id", "term_text").agg(F.min(F.when(F.col("l_suppkey") % 3 != 0, F.col("tid"))).alias("definition_internal_id"))
    return grouped.select("source_internal_id", "term_text", "definition_internal_id")


#: The same adapters for DuckDB.
ORACLE_TABLES = """
tree AS (
  SELECT 'R'||r_regionkey AS internal_id, 'R'||r_regionkey AS act_id, 'Act' AS type, r_regionkey::VARCHAR AS local_id, r_name AS title, '# '||r_name AS content_md, 1 AS level, NULL AS parent_internal_id, r_regionkey::BIGINT AS key FROM region
  UNION ALL SELECT 'R'||n_regionkey||'_N'||n_nationkey, 'R'||n_regionkey, 'Division', n_nationkey::VARCHAR, n_name, 'Division of *'||n_name||'*', 2, 'R'||n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT 'R'||n_regionkey||'_N'||n_nationkey||'_C'||c_custkey, 'R'||n_regionkey, 'Section', c_custkey::VARCHAR, c_name, 'Segment '||c_mktsegment, 3, 'R'||n_regionkey||'_N'||n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'R'||n_regionkey||'_N'||n_nationkey||'_S'||s_suppkey, 'R'||n_regionkey, 'Definition', lower(s_name), s_name, '**'||s_name||'** means a supplier.'||chr(10)||chr(10)||'See section 6-5.', 3, 'R'||n_regionkey||'_N'||n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'R'||n_regionkey||'_N'||n_nationkey||'_C'||c_custkey||'_O'||o_orderkey, 'R'||n_regionkey, 'Paragraph', o_orderkey::VARCHAR, 'Order '||o_orderkey, 'Priority '||o_orderpriority||' status '||o_orderstatus, 4, 'R'||n_regionkey||'_N'||n_nationkey||'_C'||c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
provisions AS (
  SELECT internal_id, act_id, act_id||':'||type||':'||local_id AS ref_id, type, local_id, title, content_md, level, replace(internal_id, '_', '.') AS path, parent_internal_id,
    (row_number() OVER (PARTITION BY parent_internal_id ORDER BY type, key) - 1)::INTEGER AS sibling_order, key FROM tree
),
refs AS (
  SELECT s.internal_id AS source_internal_id, CASE WHEN l_suppkey % 10 = 0 THEN 'EXT:Act:'||l_suppkey ELSE t.ref_id END AS target_ref_id,
    CASE WHEN l_suppkey % 10 <> 0 THEN t.internal_id END AS target_internal_id, l_returnflag||l_linestatus AS snippet
  FROM lineitem JOIN provisions s ON s.type = 'Paragraph' AND s.key = l_orderkey JOIN provisions t ON t.type = 'Definition' AND t.key = l_suppkey
),
terms AS (
  SELECT s.internal_id AS source_internal_id, p_name AS term_text, min(CASE WHEN l_suppkey % 3 <> 0 THEN t.internal_id END) AS definition_internal_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN provisions s ON s.type = 'Paragraph' AND s.key = l_orderkey JOIN provisions t ON t.type = 'Definition' AND t.key = l_suppkey
  GROUP BY 1, 2
)
"""
