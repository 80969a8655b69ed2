"""Document and reference ETL operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import document_snippet
from quillspark.operators.registry import tagged

# Fixed values that decide results.
EMBED_CHARS, EMBED_OVERLAP, BREAK_FROM = 2200, 350, 0.6
PACK_FROM, PACK_TO = 8000, 2000


def embedding_cuts(texts: list[str], size: int = EMBED_CHARS, overlap: int = EMBED_OVERLAP, compat: bool = True) -> list[list[str]]:
    """The chunks of each text of a batch, stripped: at most `size` characters, up to the last
    blank behind 60 % of that.  With `compat` neighbours share one character whatever the
    overlap (none if that is 0), as the loads that this engine must equal were made.

    All texts of a batch advance together, one cut a round: a blank is looked up in a table
    of the last blank at or before each place."""
    texts = [t.strip() for t in texts]
    if size <= 0:
        return [[t] if t else [] for t in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    base = np.cumsum([0, *map(len, texts)])
    length = np.diff(base)
    blank = np.maximum.accumulate(np.where(flat == 32, np.arange(len(flat)), -1)) if len(flat) else flat
    shared = min(overlap, 1) if compat else overlap
    out: list[list[str]] = [[] for _ in texts]
    going, start = np.flatnonzero(length > 0), np.zeros(len(texts), np.int64)
    while len(going):
        begin, n, at = start[going], length[going], base[going]
        end = np.minimum(begin + size, n)
        near = blank[at + end - 1] - at
        end = np.where((end < n) & (near >= begin + int(size * BREAK_FROM)) & (near > begin), near, end)
        for i, x, y in zip(going.tolist(), begin.tolist(), end.tolist(), strict=True):
            piece = texts[i][x:y].strip()
            if piece:
                out[i].append(piece)
        start[going] = np.maximum(end - np.minimum(shared, end - begin - 1), begin + 1)
        going = going[end < n]
    return out


def pack_blocks(text: str, least: int = PACK_FROM, most: int = PACK_TO) -> list[str]:
    """A long markdown text as packs of paragraphs up to `most` characters; fenced code stays whole."""
    if len(text) <= least:
        return [text]
    blocks, now, fenced = [], [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not line.strip() and not fenced:
            if now:
                blocks.append("\n".join(now))
                now = []
        else:
            now.append(line)
    if now:
        blocks.append("\n".join(now))
    packs: list[str] = []
    for block in blocks:
        if packs and len(packs[-1]) + 2 + len(block) <= most:
            packs[-1] += "\n\n" + block
        else:
            packs.append(block)
    return packs


def _exploded(docs: DataFrame, cut) -> DataFrame:
    """One row a chunk; `cut` takes the texts of a batch."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c, len(c)) for d, chunks in zip(batch["doc_id"], cut([t or "" for t in batch["text"]]), strict=True) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk", "n_chars"])

    return docs.mapInPandas(run, "doc_id bigint, chunk_index int, chunk string, n_chars bigint")


def embedding_chunks(docs: DataFrame, compat: bool = True) -> DataFrame:
    return _exploded(docs, lambda texts: embedding_cuts(texts, compat=compat))


def pack_markdown(docs: DataFrame) -> DataFrame:
    return _exploded(docs, lambda texts: [pack_blocks(t) if t else [] for t in texts])


def first_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, title, snippet, first): documents with the first of their chunks (doc_id,
    chunk_index, chunk); one without chunks isn't there."""
    first = chunks.where("chunk_index = 0").select("doc_id", F.col("chunk").alias("first"))
    return docs.join(first, "doc_id").select("doc_id", "title", document_snippet(F.col("first")).alias("snippet"), "first")


def search_documents(docs: DataFrame, chunks: DataFrame, query: str, limit: int, offset: int) -> DataFrame:
    """A page by title of the documents whose title or first chunk contains the query (all for a
    blank one), with the number of all hits.  The query's wildcards are not escaped."""
    found, pattern = first_chunks(docs, chunks), f"%{query.strip()}%"
    if query.strip():
        found = found.where(F.ilike("title", F.lit(pattern)) | F.ilike("first", F.lit(pattern)))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("title", "doc_id").offset(max(offset, 0)).limit(max(limit, 1))
    return page.select("doc_id", "title", "snippet").crossJoin(F.broadcast(total))


def salvaged(answer: Column, fields: str) -> Column:
    """A list of objects: the answer itself if it is one, else every object in it that parses."""
    kind = f"array<struct<{fields.replace(' ', ':', 1)}>>"
    whole = F.from_json(answer, kind, {"mode": "PERMISSIVE"})
    single = F.transform(F.regexp_extract_all(answer, F.lit(r"(\{.*?\})"), F.lit(1)), lambda o: F.from_json(o, f"struct<{fields.replace(' ', ':', 1)}>"))
    valid = answer.rlike(r"^\s*\[.*\]\s*$")
    return F.array_distinct(F.filter(F.when(valid, whole).otherwise(single), lambda o: o.isNotNull()))


def tag_terms(docs: DataFrame, terms: list[str], loose: bool = False) -> DataFrame:
    """(doc_id, terms): texts with the terms of a stated dictionary and their plurals."""
    listed = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    found = tagged(docs.select(F.col("doc_id").alias("id"), "text"), listed, loose=loose, marks=False)
    return found.select(F.col("id").alias("doc_id"), F.array_join("terms", ",").alias("terms"))


#: How titles of structures, and of sections at their level, are written.
STRUCTURE = r"(?i)^(Chapter|Part|Division|Subdivision)\s+([0-9A-Z\-]+)(?:\s*(?:—|--|-)\s*(.*))?$"
SECTION, SECTION_LEVEL = r"(?i)^([0-9\-A-Z]+)\s+(.*)$", 5


def sectioned(title: Column, level: Column) -> Column:
    """struct(kind, local_id, name) of a heading of this level.  At the level of sections the first word is the id; else a
    structure is named by its kind and id; what is neither is ``Level<n>Element`` and keeps its title."""
    low = F.lower(title)
    plain = low.startswith("guide to") | low.startswith("operative provision")
    section = ~plain & (level == SECTION_LEVEL) & title.rlike(SECTION)
    structure = ~plain & ~F.coalesce(section, F.lit(False)) & title.rlike(STRUCTURE)

    def part(pattern: str, i: int) -> Column:
        return F.trim(F.regexp_extract(title, pattern, i))

    kind = (
        F.when(low.startswith("guide to"), "Guide")
        .when(low.startswith("operative provision"), "OperativeProvision")
        .when(section, "Section")
        .when(structure, F.initcap(part(STRUCTURE, 1)))
        .otherwise(F.concat(F.lit("Level"), F.coalesce(level.cast("string"), F.lit("")), F.lit("Element")))
    )
    local = F.when(section, part(SECTION, 1)).when(structure, part(STRUCTURE, 2))
    name = F.when(section, part(SECTION, 2)).when(structure, part(STRUCTURE, 3)).otherwise(title)
    return F.struct(kind.alias("kind"), local.alias("local_id"), name.alias("name"))
