"""References, defined terms and provision details: joins instead of one query a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import escaped
from quillspark.operators.ordering import ranked
from quillspark.operators.tables import saved


def references_to(refs: DataFrame, p: DataFrame) -> DataFrame:
    titles = p.select(F.col("internal_id").alias("target_internal_id"), F.col("title").alias("target_title"))
    return refs.join(titles, "target_internal_id", "left").select("source_internal_id", "target_ref_id", "target_internal_id", "snippet", "target_title")


def referenced_by(refs: DataFrame, p: DataFrame) -> DataFrame:
    sources = p.select(F.col("internal_id").alias("source_internal_id"), F.col("ref_id").alias("source_ref_id"), F.col("title").alias("source_title"))
    known = refs.where("target_internal_id IS NOT NULL").select("target_internal_id", "source_internal_id").distinct()
    return known.join(sources, "source_internal_id")


def defined_terms(terms: DataFrame, p: DataFrame) -> DataFrame:
    names = p.select(F.col("internal_id").alias("definition_internal_id"), F.col("title").alias("definition_title"))
    return terms.join(names, "definition_internal_id", "left").select("source_internal_id", "term_text", "definition_internal_id", "definition_title")


def listed(column: str) -> Column:
    """The distinct values of a group, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def definitions_of(terms: DataFrame, p: DataFrame) -> DataFrame:
    """One row a (source, definition): its terms, title and first paragraph."""
    grouped = terms.where("definition_internal_id IS NOT NULL").groupBy("source_internal_id", "definition_internal_id").agg(listed("term_text").alias("term_texts"))
    body = p.select(F.col("internal_id").alias("definition_internal_id"), F.col("title").alias("definition_title"), F.split("content_md", "\n\n")[0].alias("definition_text"))
    return grouped.join(body, "definition_internal_id")


def definition_references(terms: DataFrame, refs: DataFrame, p: DataFrame) -> DataFrame:
    """(source_internal_id, definition_internal_id, target_ref_id, target_internal_id, snippet,
    target_title): what the definitions that a provision uses refer to themselves."""
    used = terms.where("definition_internal_id IS NOT NULL").select("source_internal_id", "definition_internal_id").distinct()
    own = references_to(refs, p).withColumnRenamed("source_internal_id", "definition_internal_id")
    return used.join(own, "definition_internal_id").select("source_internal_id", "definition_internal_id", "target_ref_id", "target_internal_id", "snippet", "target_title")


def child_rows(p: DataFrame) -> DataFrame:
    """(parent_internal_id, place, internal_id, title, type): children without definitions in sibling order."""
    own = p.where("parent_internal_id IS NOT NULL").where((F.lower("type") != "definition") & ~F.col("ref_id").like("%:Definition:%"))
    order = [F.asc("parent_internal_id"), F.asc_nulls_last("sibling_order"), F.asc("internal_id")]
    rows = saved(ranked(own.select("parent_internal_id", "sibling_order", "internal_id", "title", "type"), order, "at"))
    first = rows.groupBy("parent_internal_id").agg(F.min("at").alias("first"))
    return rows.join(first, "parent_internal_id").select("parent_internal_id", (F.col("at") - F.col("first") + 1).cast("int").alias("place"), "internal_id", "title", "type")


def etag(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in parts)), 256)


def details(p: DataFrame, refs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every provision with its relationships: five joins in place of one query a node."""
    to = refs.groupBy(F.col("source_internal_id").alias("internal_id")).agg(F.count("*").alias("n_references"), listed("target_ref_id").alias("reference_ids"))
    by = refs.where("target_internal_id IS NOT NULL").groupBy(F.col("target_internal_id").alias("internal_id")).agg(F.count_distinct("source_internal_id").alias("n_referenced_by"))
    used = terms.groupBy(F.col("source_internal_id").alias("internal_id")).agg(listed("term_text").alias("term_texts"))
    kids = p.where("parent_internal_id IS NOT NULL").groupBy(F.col("parent_internal_id").alias("internal_id")).agg(F.count("*").alias("n_children"))
    joined = p.join(to, "internal_id", "left").join(by, "internal_id", "left").join(used, "internal_id", "left").join(kids, "internal_id", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    out = joined.select(
        "internal_id",
        "ref_id",
        "type",
        "title",
        F.coalesce("n_references", zero).alias("n_references"),
        F.coalesce("reference_ids", none).alias("reference_ids"),
        F.coalesce("n_referenced_by", zero).alias("n_referenced_by"),
        F.coalesce("term_texts", none).alias("term_texts"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.octet_length("content_md").cast("long").alias("size_bytes"),
        "content_md",
    )
    return out.withColumn("etag", etag(F.col("internal_id"), F.col("ref_id"), F.col("content_md"), F.col("reference_ids"), F.col("term_texts"))).drop("content_md")


def batch(requested: DataFrame, detail: DataFrame) -> DataFrame:
    """The requested ids in order, with an error text for those that don't exist."""
    found = requested.join(detail, "internal_id", "left")
    return found.withColumn("error", F.when(F.col("ref_id").isNull(), F.concat(F.lit("Provision not found: "), "internal_id")))


def lookup(p: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, internal_id): by ref id, else by local id, without regard to case; the least id of several."""
    key = F.upper("token")
    by_ref = tokens.join(p, key == F.upper("ref_id")).groupBy("token").agg(F.min("internal_id").alias("by_ref"))
    by_local = tokens.join(p, key == F.upper("local_id")).groupBy("token").agg(F.min("internal_id").alias("by_local"))
    return tokens.join(by_ref, "token", "left").join(by_local, "token", "left").select("token", F.coalesce("by_ref", "by_local").alias("internal_id"))


def degrees(refs: DataFrame, p: DataFrame) -> DataFrame:
    """Distinct other sources, and distinct targets (external and own ones included)."""
    ins = refs.where("target_internal_id IS NOT NULL AND target_internal_id <> source_internal_id").groupBy(F.col("target_internal_id").alias("internal_id")).agg(F.count_distinct("source_internal_id").alias("in_degree"))
    outs = refs.groupBy(F.col("source_internal_id").alias("internal_id")).agg(F.count_distinct("target_ref_id").alias("out_degree"))
    zero = F.lit(0).cast("long")
    return p.select("internal_id").join(ins, "internal_id", "left").join(outs, "internal_id", "left").select("internal_id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def clickables(refs: DataFrame, terms: DataFrame, p: DataFrame) -> DataFrame:
    """(internal_id, text, kind, target): what a reader can follow in a node's text.

    A reference counts by its snippet: "ref" if it leads to a node or into the same act and has
    a title, "external" if into another act (its target then is the words to search for); a term
    with a definition counts as it is and between asterisks."""
    acts = p.select(F.col("internal_id").alias("source_internal_id"), "act_id")
    cited = references_to(refs, p).where("snippet <> '' AND target_ref_id <> ''").join(acts, "source_internal_id")
    found = F.col("target_internal_id").isNotNull()
    inside = found | F.col("target_ref_id").startswith(F.col("act_id"))
    shown = cited.where(~inside | found | F.col("target_title").isNotNull()).select(
        F.col("source_internal_id").alias("internal_id"), F.col("snippet").alias("text"), F.when(inside, "ref").otherwise("external").alias("kind"),
        F.when(inside, F.col("target_ref_id")).otherwise(F.regexp_replace("target_ref_id", "[:_-]+", " ")).alias("target"),
    )
    defined = terms.where("definition_internal_id IS NOT NULL AND term_text <> ''")
    forms = F.explode(F.array("term_text", F.concat(F.lit("*"), "term_text", F.lit("*")))).alias("text")
    named = defined.select(F.col("source_internal_id").alias("internal_id"), forms, F.lit("term").alias("kind"), F.col("definition_internal_id").alias("target"))
    return shown.union(named).distinct()


def tokenised(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """(internal_id, place, text, kind, target): the text of each node (internal_id, text) in pieces,
    those that stand for an item (`clickables`) with its kind and target.

    Items are looked for longest first, whatever their case, where no word goes on before or
    after them; of several with the same text references come first, then the least target.  A
    node's items are what one text cites, so they fit a row."""
    rank = F.when(F.col("kind") == "term", 1).otherwise(0)
    own = items.groupBy("internal_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("text")).alias("n"), rank.alias("rank"), "target", "kind", "text"))).alias("items"))
    words = F.array_join(F.transform(F.array_distinct(F.transform("items", lambda i: F.struct(i["n"], i["text"]))), lambda i: escaped(i["text"])), "|")
    told = nodes.where("text <> ''").join(own, "internal_id", "left").withColumn("p", F.concat(F.lit(r"(?iu)(?<!\w)(?:"), F.coalesce(words, F.lit("(?!)")), F.lit(r")(?!\w)")))
    hits = F.regexp_extract_all("text", F.col("p"), F.lit(0))
    plain = F.lit(None).cast("struct<n:int,rank:int,target:string,kind:string,text:string>")
    pieces = F.flatten(F.zip_with(F.split("text", F.col("p"), -1), hits, lambda a, b: F.array(F.struct(a.alias("t"), F.lit(False).alias("hit")), F.struct(b.alias("t"), F.lit(True).alias("hit")))))
    cut = told.select("internal_id", "items", F.posexplode(F.filter(pieces, lambda x: x["t"] != "")).alias("place", "x"))
    item = F.when(F.col("x.hit"), F.get(F.filter("items", lambda i: F.lower(i["text"]) == F.lower(F.col("x.t"))), F.lit(0))).otherwise(plain)
    return cut.withColumn("item", item).select("internal_id", "place", F.col("x.t").alias("text"), F.coalesce("item.kind", F.lit("plain")).alias("kind"), F.col("item.target").alias("target"))
