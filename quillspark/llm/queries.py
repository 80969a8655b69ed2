"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table


Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.phrase_automata import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lm_scoring import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.ordinal import KEEP_TAIL, graded, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, graded(table(spark, sf_dir, "labels")), n_grades=3)
    tails = score(docs, model)
    return tails.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"), (F.col("tails")[1] >= KEEP_TAIL).alias("keep"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_array import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard_join import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.transport_stream import decode, encode

    return decode(encode(table(spark, sf_dir, "documents")), with_payload=False)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quotation import link

    return link(table(spark, sf_dir, "conversations"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.alignment import links

    return links(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), with_groups=False)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.vector_packing import pack_vectors

    return pack_vectors(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_phrase_automata": op3_phrase_automata,
    "op4_context_tree": op4_context_tree,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_suffix_array": op6_suffix_array,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_transport_stream": op10_transport_stream,
    "op11_token_alignment": op11_token_alignment,
    "op12_vector_packing": op12_vector_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_phrase_automata": f"""
WITH w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
t AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM t WHERE i + 34 <= len(ws)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
flagged AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (h)),
marked AS (SELECT t.doc_id, t.i, t.ws[t.i] AS word, max((f.i IS NOT NULL)::INT) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM t LEFT JOIN flagged f ON f.doc_id = t.doc_id AND f.i = t.i),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM marked GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
d AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS root, a AS id FROM d UNION SELECT root, d.b FROM reach JOIN d ON d.a = reach.id),
least AS (SELECT id, min(root) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.id = w.doc_id""",
    "op13_hard_negatives": """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
