"""Hierarchy, reference and detail queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import hierarchy as H
from quillspark.operators import relations as R
from quillspark.operators import tables as T
from quillspark.plans.catalog import register
from quillspark.sources.model import provisions, references, table, term_usage

NODE = ["internal_id", "ref_id", "type", "title", "sibling_order", "has_children"]
_FLAG = "EXISTS (SELECT 1 FROM provisions c WHERE c.parent_internal_id = p.internal_id AND c.act_id = p.act_id AND c.type <> 'Definition') AS has_children"


@register(f"SELECT internal_id, ref_id, type, title, sibling_order, {_FLAG} FROM provisions p WHERE act_id = 'R1' AND parent_internal_id = 'R1_N1' AND type <> 'Definition' ORDER BY sibling_order, path", tables=True)
def hierarchy_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.children(provisions(spark, sf_dir), "R1", "R1_N1").orderBy(*H.sibling_sort()).select(*NODE)


@register(f"SELECT internal_id, ref_id, type, title, sibling_order, {_FLAG} FROM provisions p WHERE act_id = 'R1' AND parent_internal_id IS NULL AND type <> 'Definition'", tables=True)
def hierarchy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.children(provisions(spark, sf_dir), "R1", None).orderBy(*H.sibling_sort()).select(*NODE)


@register("SELECT b.internal_id, a.internal_id AS ancestor_id, a.title AS ancestor_title FROM provisions b JOIN provisions a ON a.internal_id IN (b.internal_id, b.parent_internal_id, (SELECT parent_internal_id FROM provisions x WHERE x.internal_id = b.parent_internal_id), b.act_id)", tables=True)
def ancestors_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = provisions(spark, sf_dir)
    return H.ancestors(p, p).select("internal_id", "ancestor_id", "ancestor_title")


@register(
    """--cte up AS (SELECT internal_id, internal_id AS at, 0 AS hop FROM provisions UNION ALL SELECT up.internal_id, p.parent_internal_id, hop + 1 FROM up JOIN provisions p ON p.internal_id = up.at WHERE p.parent_internal_id IS NOT NULL)
SELECT up.internal_id, string_agg(p.title, ' > ' ORDER BY hop DESC) AS trail FROM up JOIN provisions p ON p.internal_id = up.at GROUP BY 1""",
    tables=True,
    recursive=True,
)
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = provisions(spark, sf_dir)
    return H.breadcrumbs(p, p)


@register("SELECT internal_id, path, level, sibling_order FROM provisions WHERE path = 'R2' OR starts_with(path, 'R2.')", tables=True)
def subtree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(provisions(spark, sf_dir), "R2").orderBy("path", F.coalesce("sibling_order", F.lit(0))).select("internal_id", "path", "level", "sibling_order")


@register(
    f"""--cte hits AS (SELECT * FROM provisions WHERE act_id = 'R1' AND type <> 'Definition' AND list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), 'nation') AND list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), '1')),
up AS (SELECT internal_id AS id FROM hits UNION SELECT p.parent_internal_id FROM up JOIN provisions p ON p.internal_id = up.id WHERE p.parent_internal_id IS NOT NULL)
SELECT internal_id, ref_id, type, title, sibling_order, {_FLAG}, internal_id IN (SELECT internal_id FROM hits) AS matched FROM provisions p WHERE internal_id IN (SELECT id FROM up)""",
    tables=True,
    recursive=True,
)
def hierarchy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search_titles(provisions(spark, sf_dir), "R1", "nation 1").orderBy(*H.sibling_sort()).select(*NODE, "matched")


@register(
    """--cte walk AS (SELECT internal_id, internal_id AS built, 1 AS depth FROM provisions WHERE parent_internal_id IS NULL UNION ALL SELECT p.internal_id, built || '.' || string_split(p.internal_id, '_')[-1], depth + 1 FROM walk JOIN provisions p ON p.parent_internal_id = walk.internal_id)
SELECT internal_id, built, depth FROM walk""",
    tables=True,
    recursive=True,
)
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.path_levels(provisions(spark, sf_dir))


@register("SELECT internal_id, row_number() OVER (ORDER BY list_transform(string_split(path, '.'), lambda x: left(x, 1) || lpad(substr(x, 2), 12, '0')), coalesce(sibling_order, 2147483647), internal_id) AS place FROM provisions", tables=True)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive numeric-aware order; a global rank by ranges."""
    p = provisions(spark, sf_dir)
    keyed = p.select("internal_id", X.natural_key(F.col("path")).alias("k"), F.coalesce("sibling_order", F.lit(2147483647)).alias("s"))
    from quillspark.operators.ordering import ranked

    return ranked(keyed, ["k", "s", "internal_id"], "place").select("internal_id", (F.col("place") + 1).alias("place"))


@register("SELECT source_internal_id, target_ref_id, target_internal_id, snippet, t.title AS target_title FROM refs LEFT JOIN provisions t ON t.internal_id = target_internal_id", tables=True)
def references_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.references_to(references(spark, sf_dir), provisions(spark, sf_dir))


@register("SELECT DISTINCT target_internal_id, source_internal_id, s.ref_id AS source_ref_id, s.title AS source_title FROM refs JOIN provisions s ON s.internal_id = source_internal_id WHERE target_internal_id IS NOT NULL", tables=True)
def referenced_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.referenced_by(references(spark, sf_dir), provisions(spark, sf_dir)).select("target_internal_id", "source_internal_id", "source_ref_id", "source_title")


@register("SELECT source_internal_id, term_text, definition_internal_id, d.title AS definition_title FROM terms LEFT JOIN provisions d ON d.internal_id = definition_internal_id", tables=True)
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.defined_terms(term_usage(spark, sf_dir), provisions(spark, sf_dir))


@register("SELECT source_internal_id, definition_internal_id, string_agg(DISTINCT term_text, ',' ORDER BY term_text) AS term_texts, any_value(d.title) AS definition_title, any_value(string_split(d.content_md, chr(10)||chr(10))[1]) AS definition_text FROM terms JOIN provisions d ON d.internal_id = definition_internal_id GROUP BY 1, 2", tables=True)
def definitions_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.definitions_of(term_usage(spark, sf_dir), provisions(spark, sf_dir)).select("source_internal_id", "definition_internal_id", "term_texts", "definition_title", "definition_text")


_DETAIL = """--cte detail AS (
SELECT p.internal_id, p.ref_id, p.type, p.title, coalesce(n_references, 0) AS n_references, coalesce(reference_ids, '') AS reference_ids, coalesce(n_referenced_by, 0) AS n_referenced_by, coalesce(term_texts, '') AS term_texts, coalesce(n_children, 0) AS n_children, strlen(content_md)::BIGINT AS size_bytes,
  sha256(concat_ws('|', p.internal_id, p.ref_id, content_md, coalesce(reference_ids, ''), coalesce(term_texts, ''))) AS etag
FROM provisions p
LEFT JOIN (SELECT source_internal_id AS id, count(*) AS n_references, string_agg(DISTINCT target_ref_id, ',' ORDER BY target_ref_id) AS reference_ids FROM refs GROUP BY 1) a ON a.id = p.internal_id
LEFT JOIN (SELECT target_internal_id AS id, count(DISTINCT source_internal_id) AS n_referenced_by FROM refs WHERE target_internal_id IS NOT NULL GROUP BY 1) b ON b.id = p.internal_id
LEFT JOIN (SELECT source_internal_id AS id, string_agg(DISTINCT term_text, ',' ORDER BY term_text) AS term_texts FROM terms GROUP BY 1) c ON c.id = p.internal_id
LEFT JOIN (SELECT parent_internal_id AS id, count(*) AS n_children FROM provisions GROUP BY 1) k ON k.id = p.internal_id)
"""


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.details(provisions(spark, sf_dir), references(spark, sf_dir), term_usage(spark, sf_dir))


@register(_DETAIL + "SELECT * FROM detail", tables=True)
def provision_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir)


@register(_DETAIL + "SELECT ids.internal_id, ref_id, title, coalesce(n_children, 0) AS n_children, etag, CASE WHEN ref_id IS NULL THEN 'Provision not found: ' || ids.internal_id END AS error FROM (VALUES ('R0'), ('R1_N1'), ('R9_N9'), ('missing')) ids(internal_id) LEFT JOIN detail USING (internal_id)", tables=True)
def batch_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("R0",), ("R1_N1",), ("R9_N9",), ("missing",)], "internal_id string")
    return R.batch(F.broadcast(asked), _details(spark, sf_dir)).select("internal_id", "ref_id", "title", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "etag", "error")


@register(
    """SELECT token, coalesce((SELECT min(internal_id) FROM provisions WHERE upper(ref_id) = upper(token)), (SELECT min(internal_id) FROM provisions WHERE upper(local_id) = upper(token))) AS internal_id
FROM (VALUES ('r1:division:1'), ('R0:Act:0'), ('17'), ('nothing')) t(token)""",
    tables=True,
)
def ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("r1:division:1",), ("R0:Act:0",), ("17",), ("nothing",)], "token string")
    return R.lookup(provisions(spark, sf_dir), F.broadcast(asked))


@register("SELECT p.internal_id, count(DISTINCT i.source_internal_id) AS in_degree, any_value(coalesce(o.n, 0)) AS out_degree FROM provisions p LEFT JOIN refs i ON i.target_internal_id = p.internal_id AND i.source_internal_id <> p.internal_id LEFT JOIN (SELECT source_internal_id AS id, count(DISTINCT target_ref_id) AS n FROM refs GROUP BY 1) o ON o.id = p.internal_id GROUP BY 1", tables=True)
def degree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.degrees(references(spark, sf_dir), provisions(spark, sf_dir))


@register("SELECT coalesce(m.id, r.id) AS id, coalesce(r.title, m.title) AS title, r.id IS NOT NULL AS stored FROM (VALUES ('R0', 'Configured zero'), ('R7', 'Configured only')) m(id, title) FULL JOIN (SELECT 'R' || r_regionkey AS id, r_name AS title FROM region) r ON r.id = m.id")
def acts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([("R0", "Configured zero"), ("R7", "Configured only")], "cid string, ctitle string")
    stored = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("sid"), F.col("r_name").alias("stitle"))
    both = configured.join(stored, F.col("cid") == F.col("sid"), "full")
    return both.select(F.coalesce("cid", "sid").alias("id"), F.coalesce("stitle", "ctitle").alias("title"), F.col("sid").isNotNull().alias("stored"))


@register(
    """SELECT internal_id, type, CASE WHEN type IN ('Division', 'Section') THEN type || ' ' || local_id ELSE title END AS label,
  CASE WHEN type IN ('Division', 'Section') THEN type || ' ' || local_id || ' — ' || title ELSE title END AS heading,
  CASE type WHEN 'Division' THEN 'Division ' || local_id || '|division ' || local_id || '|Div ' || local_id || '|div ' || local_id || '|' || ref_id
    WHEN 'Section' THEN 'Section ' || local_id || '|section ' || local_id || '|Sect ' || local_id || '|sect ' || local_id || '|s ' || local_id || '|' || ref_id
    WHEN 'Act' THEN title || '|Act|' || ref_id ELSE title || '|' || ref_id END AS variants FROM provisions""",
    tables=True,
)
def heading_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = X.heading_label(F.col("type"), F.col("title"), F.col("local_id"), F.col("ref_id"))
    found = provisions(spark, sf_dir).select("internal_id", "type", label.alias("h"))
    return found.select("internal_id", "type", "h.label", "h.heading", F.array_join("h.variants", "|").alias("variants"))


@register("SELECT DISTINCT t.source_internal_id, t.definition_internal_id, p.parent_internal_id AS target_internal_id, d.title AS target_title FROM terms t JOIN provisions p ON p.internal_id = t.definition_internal_id JOIN provisions d ON d.internal_id = p.parent_internal_id", tables=True)
def definition_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What used definitions refer to themselves; in these tables a definition cites its division."""
    p = provisions(spark, sf_dir)
    own = p.where("type = 'Definition'").select(F.col("internal_id").alias("source_internal_id"), F.col("parent_internal_id").alias("target_ref_id"), F.col("parent_internal_id").alias("target_internal_id"), F.lit("").alias("snippet"))
    return R.definition_references(term_usage(spark, sf_dir), own, p).select("source_internal_id", "definition_internal_id", "target_internal_id", "target_title")


@register("SELECT parent_internal_id, internal_id, (row_number() OVER (PARTITION BY parent_internal_id ORDER BY sibling_order, internal_id))::INTEGER AS place FROM provisions WHERE parent_internal_id IS NOT NULL AND type <> 'Definition'", tables=True)
def detail_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.child_rows(provisions(spark, sf_dir)).select("parent_internal_id", "internal_id", "place")


@register("SELECT source_internal_id, term_text, definition_internal_id FROM terms WHERE definition_internal_id IS NULL OR definition_internal_id NOT IN (SELECT internal_id FROM provisions WHERE type = 'Definition' AND act_id = 'R1')", tables=True)
def purge_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term uses after the definitions of an act are gone."""
    gone = provisions(spark, sf_dir).where("type = 'Definition' AND act_id = 'R1'").select(F.col("internal_id").alias("definition_internal_id"))
    return T.purge(term_usage(spark, sf_dir), gone, "definition_internal_id")


_EXPORT = "'## ' || coalesce(nullif(title, ''), ref_id) || chr(10) || chr(10) || content_md"


@register(f"SELECT parent_internal_id, string_agg({_EXPORT}, chr(10) || chr(10) ORDER BY path, coalesce(sibling_order, 0)) AS markdown FROM provisions WHERE parent_internal_id IS NOT NULL GROUP BY 1", tables=True)
def subtree_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("## "), F.coalesce(F.nullif("title", F.lit("")), "ref_id"), F.lit("\n\n"), "content_md")
    p = provisions(spark, sf_dir).where("parent_internal_id IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("path", F.coalesce("sibling_order", F.lit(0)).alias("s"), block.alias("block"))))
    return p.groupBy("parent_internal_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("markdown"))


@register("SELECT source_internal_id, target_ref_id, count(*) AS occurrences, string_agg(DISTINCT snippet, ',' ORDER BY snippet) AS snippets FROM refs WHERE target_internal_id IS NULL GROUP BY 1, 2", tables=True)
def unresolved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = references(spark, sf_dir).where("target_internal_id IS NULL")
    return lost.groupBy("source_internal_id", "target_ref_id").agg(F.count("*").alias("occurrences"), R.listed("snippet").alias("snippets"))


@register("SELECT DISTINCT source_internal_id, target_ref_id, target_internal_id, snippet FROM refs", tables=True)
def load_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).dropDuplicates()


@register("SELECT internal_id, CASE WHEN type = 'Division' THEN lower(title) ELSE '' END AS markers FROM provisions WHERE content_md LIKE '%*%' AND type <> 'Definition'", tables=True)
def term_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asterisked terms of each text; the division names are marked."""
    p = provisions(spark, sf_dir).where("content_md LIKE '%*%' AND type <> 'Definition'")
    return p.select("internal_id", F.array_join(X.term_markers(F.translate("content_md", "_", "-")), ",").alias("markers")).withColumn("markers", F.translate("markers", "-", "_"))


@register()
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of one division with references, definitions and what stays unresolved."""
    from quillspark.operators import export as E

    p, refs, terms = provisions(spark, sf_dir), references(spark, sf_dir), term_usage(spark, sf_dir)
    shown = E.parts(p, refs, terms, "R1_N1")
    return E.markdown(shown, E.unresolved(p, refs, shown))


@register(
    """--cte copied AS (SELECT * FROM provisions WHERE path = 'R1.N1' OR starts_with(path, 'R1.N1.')),
cited AS (SELECT DISTINCT target_internal_id AS id FROM refs WHERE source_internal_id IN (SELECT internal_id FROM copied) AND target_internal_id IS NOT NULL AND target_internal_id NOT IN (SELECT internal_id FROM copied)),
shown AS (SELECT internal_id AS id FROM copied UNION SELECT id FROM cited),
needed AS (SELECT id FROM shown UNION SELECT definition_internal_id FROM needed JOIN terms ON source_internal_id = id WHERE definition_internal_id IS NOT NULL)
SELECT internal_id, 'copied' AS part FROM copied UNION ALL SELECT id, 'referenced' FROM cited UNION ALL SELECT id, 'definition' FROM needed WHERE id NOT IN (SELECT id FROM shown)""",
    tables=True,
    recursive=True,
)
def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export holds, and as which part."""
    from quillspark.operators import export as E

    return E.parts(provisions(spark, sf_dir), references(spark, sf_dir), term_usage(spark, sf_dir), "R1_N1").select("internal_id", "part")


@register("SELECT p.internal_id, count(*) AS n_visible FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '.')) + 1), lambda i: array_to_string(string_split(path, '.')[1:i], '.'))) AS up FROM provisions) JOIN provisions p ON p.path = up GROUP BY 1", tables=True)
def visible_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes an opened node shows, itself included."""
    p = provisions(spark, sf_dir)
    found = p.select(F.explode(H.prefixes(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n_visible"))
    return found.join(p.select("path", "internal_id"), "path").select("internal_id", "n_visible")


@register(
    """--cte trail AS (SELECT p.internal_id, string_agg(a.title, ' ⟶ ' ORDER BY a.path) AS trail FROM provisions p JOIN provisions a ON starts_with(p.path || '.', a.path || '.') GROUP BY 1),
kids AS (SELECT parent_internal_id AS internal_id, string_agg('- **' || title || '**  ' || chr(10) || '  `' || ref_id || '` — `internal_id: ' || internal_id || '`', chr(10) ORDER BY sibling_order NULLS LAST, internal_id) AS kids FROM provisions WHERE parent_internal_id IS NOT NULL AND type <> 'Definition' GROUP BY 1),
line AS (SELECT source_internal_id AS internal_id, target_ref_id, snippet, title FROM refs JOIN (SELECT internal_id AS t, title FROM provisions) ON t = target_internal_id),
cited AS (SELECT internal_id, string_agg('- **' || title || '**' || chr(10) || '  `' || target_ref_id || '`', chr(10) ORDER BY target_ref_id, snippet) AS refs FROM line GROUP BY 1),
used AS (SELECT DISTINCT source_internal_id AS internal_id, definition_internal_id AS d FROM terms WHERE definition_internal_id IS NOT NULL),
defs AS (SELECT used.internal_id, string_agg('- "' || title || '" `' || ref_id || '`' || chr(10) || '    ' || string_split(content_md, chr(10) || chr(10))[1] || chr(10), chr(10) ORDER BY d) AS defs FROM used JOIN provisions p ON p.internal_id = d GROUP BY 1)
SELECT p.internal_id, rtrim(concat_ws(chr(10), '## ' || title, '`' || ref_id || '` *' || type || '*', chr(10) || '### Breadcrumbs' || chr(10) || trail, chr(10) || '### Children' || chr(10) || kids, chr(10) || '### Content' || chr(10) || content_md,
  chr(10) || '### References' || chr(10) || refs, chr(10) || '### Definitions' || chr(10) || defs), chr(10)) AS markdown
FROM provisions p LEFT JOIN trail USING (internal_id) LEFT JOIN kids USING (internal_id) LEFT JOIN cited USING (internal_id) LEFT JOIN defs USING (internal_id)""",
    tables=True,
)
def detail_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provision as a page."""
    from quillspark.operators.pages import detail_pages

    return detail_pages(provisions(spark, sf_dir), references(spark, sf_dir), term_usage(spark, sf_dir))
