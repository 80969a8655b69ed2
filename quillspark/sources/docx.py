"""Word documents as rows of blocks, from the zip and XML themselves.

``read_blocks`` distributes files (binaryFile) and emits one row a paragraph or table in
body order; ``sections`` turns a document's blocks into headed markdown sections.  The
state that markdown lists need lives within one document, which is one group.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

# Styles that are headings, and that hold no content.
HEADINGS = {f"ActHead {k}": k for k in range(1, 6)}
IGNORED = {"Header", "Footer", "ShortT", "LongT", "CompiledActNo"}
IGNORED_STARTS = ("toc ", "TofSects(")

BLANKS = " \t\r\n\u00a0"

BLOCK_SCHEMA = "path string, ordinal int, kind string, style string, text string, num_id string, list_level int, ordered boolean, indent_points double, lead string"


def _val(node, tag: str) -> str | None:
    found = node.find(W + tag) if node is not None else None
    return found.get(W + "val") if found is not None else None


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    return {s.get(W + "styleId", ""): _val(s, "name") or "" for s in root.iter(W + "style")}


def _formats(archive: zipfile.ZipFile) -> dict[tuple[str, int], str]:
    """Numbering format by (list, level)."""
    if "word/numbering.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/numbering.xml"))
    levels = {a.get(W + "abstractNumId"): {int(x.get(W + "ilvl", "0")): _val(x, "numFmt") or "" for x in a.iter(W + "lvl")} for a in root.iter(W + "abstractNum")}
    return {(n.get(W + "numId", ""), k): f for n in root.iter(W + "num") for k, f in levels.get(_val(n, "abstractNumId"), {}).items()}


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag == W + "br":
            out.append("\n")
    return "".join(out)


def _lead(paragraph) -> str:
    """The leading text that is both bold and italic."""
    out = ""
    for run in paragraph.iter(W + "r"):
        text, props = _text(run), run.find(W + "rPr")
        if not text.strip() and not out:
            continue
        if props is None or props.find(W + "b") is None or props.find(W + "i") is None:
            break
        out += text
    return out.strip()


def table_markdown(rows: list[list[str]]) -> str:
    """A pipe table: short rows are filled, blank rows dropped, the first row is the head."""
    wide = max(map(len, rows), default=0)
    full = [[c.strip().replace("\n", " ").replace(" ", " ") for c in r] + [""] * (wide - len(r)) for r in rows]
    full = [r for r in full if any(r)]
    if not full:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n" + "\n".join([lines[0], "|---" * wide + "|", *lines[1:]]) + "\n\n"


def parse_blocks(path: str, content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles, formats = _styles(archive), _formats(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(W + "body")
    out = []
    for i, node in enumerate(body if body is not None else []):
        if node.tag == W + "p":
            props = node.find(W + "pPr")
            style = _val(props, "pStyle")
            numbering = props.find(W + "numPr") if props is not None else None
            num, level = _val(numbering, "numId"), int(_val(numbering, "ilvl") or 0)
            indent = props.find(W + "ind") if props is not None else None
            twips = float(indent.get(W + "left", indent.get(W + "start", "0"))) if indent is not None else 0.0
            ordered = formats.get((num, level), "decimal").lower() not in {"bullet", "none"} if num else None
            out.append((path, i, "paragraph", styles.get(style or "", style), _text(node).replace(" ", " ").strip(), num, level if num else None, ordered, twips / 20, _lead(node)))
        elif node.tag == W + "tbl":
            rows = [["\n".join(_text(p) for p in cell.iter(W + "p")) for cell in row.iter(W + "tc")] for row in node.iter(W + "tr")]
            out.append((path, i, "table", None, table_markdown(rows), None, None, None, 0.0, ""))
    return out


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(document, partname, content_type, content): the images in every .docx under `path`, a row each."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.startswith("word/media/") and not name.endswith("/"):
                            yield pd.DataFrame({"path": [at], "partname": ["/" + name], "content": [archive.read(name)]})

    rows = found.mapInPandas(run, "path string, partname string, content binary")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("document"), "partname", F.lit(None).cast("string").alias("content_type"), "content")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a block of every .docx under `path`."""
    return blocks_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def converted(spark: SparkSession, sources: str, done: str, convert: Callable[[bytes], bytes]) -> DataFrame:
    """(path, content) of the .docx volumes under `done`, and of what `convert` (an office converter
    where the executors have one) makes of the .rtf volumes under `sources` that have none there
    or a newer date."""
    def listed(kind: str, folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(folder)
        return files.withColumn("volume", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))

    old, new = listed("docx", done), listed("rtf", sources)
    dates = old.select("volume", F.col("modificationTime").alias("converted_at"))
    stale = new.join(dates, "volume", "left").where("converted_at IS NULL OR converted_at < modificationTime")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": [f"{v}.docx" for v in batch["volume"]], "content": [convert(bytes(c)) for c in batch["content"]]})

    kept = old.join(stale.select("volume"), "volume", "left_anti").select("path", "content")
    return kept.union(stale.select("volume", "content").mapInPandas(run, "path string, content binary"))


def blocks_of(files: DataFrame) -> DataFrame:
    """One row a block of Word files (path, content)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse_blocks(p, bytes(c)), columns=names)

    return files.mapInPandas(run, BLOCK_SCHEMA)


class Lists:
    """Renders list items one after another: the open lists are a stack of (level, id, ordered)."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, bool]] = []

    def item(self, text: str, num: str, level: int, ordered: bool, anything_before: bool) -> str:
        # a level whose parent was never shown is pulled up below the deepest open one
        level = min(level, self.open[-1][0] + 1) if self.open else 0
        resumed = any(o[1:] == (num, ordered) for o in self.open if o[0] > level)
        began, kept = bool(self.open), [o for o in self.open if o[0] < level or (o[0] == level and o[1] == num)]
        another = kept[-1:] != [(level, num, ordered)]
        if another:
            kept = [o for o in kept if o[0] < level] + [(level, num, ordered)]
        gap = another and began and anything_before and len(kept) == 1 and not resumed
        self.open = kept
        return ("\n" if gap else "") + "    " * level + ("1. " if ordered else "- ") + text + "\n"

    def close(self, anything_before: bool) -> str:
        ended, self.open = bool(self.open), []
        return "\n" if ended and anything_before else ""


def indentation(points: float) -> str:
    """Four blanks for every 36 points, eight times at most."""
    return "    " * max(0, min(int(round((points or 0) / 36)), 8))


def ignored(style: str | None) -> bool:
    names = {style or "", (style or "").split(",", 1)[0].strip()}
    return bool(names & IGNORED) or any(n.startswith(IGNORED_STARTS) for n in names if n)


def definition_body(text: Column, term: Column) -> Column:
    """The text of a definition without its term and what introduces it."""
    begins = F.startswith(F.lower(text), F.lower(term))
    rest = F.btrim(F.when(begins, F.substr(text, F.length(term) + 1)).otherwise(text), F.lit(BLANKS))
    rest = F.when(rest.rlike("^[:—-]"), F.btrim(F.substr(rest, F.lit(2)), F.lit(BLANKS))).otherwise(rest)
    return F.when(F.lower(rest).startswith("means:"), F.btrim(F.substr(rest, F.lit(7)), F.lit(BLANKS))).otherwise(rest)


def _section_rows(blocks: pd.DataFrame) -> pd.DataFrame:
    rows, body, lists = [], "", Lists()
    head: tuple[int, str] = (0, "")
    order = 0

    def put() -> None:
        if head[1] or body.strip():
            rows.append((blocks["path"].iloc[0], order, head[0], head[1], body))

    for b in blocks.sort_values("ordinal").itertuples():
        if ignored(b.style) or not b.text:
            continue
        level = HEADINGS.get((b.style or "").split(",", 1)[0].strip(), 0)
        if level:
            put()
            order, head, body, lists = b.ordinal, (level, b.text), "", Lists()
        elif b.kind == "table":
            body += lists.close(bool(body)) + b.text
        elif b.num_id:
            body += lists.item(b.text, b.num_id, int(b.list_level), bool(b.ordered), bool(body))
        else:
            body += lists.close(bool(body)) + indentation(b.indent_points) + b.text + "\n\n"
    put()
    return pd.DataFrame(rows, columns=["path", "ordinal", "level", "title", "content_md"])


def sections(blocks: DataFrame) -> DataFrame:
    """(path, ordinal, level, title, content_md): a section from each heading to the next."""
    return blocks.groupBy("path").applyInPandas(_section_rows, "path string, ordinal int, level int, title string, content_md string")


def definitions(blocks: DataFrame) -> DataFrame:
    """(path, ordinal, term, text): paragraphs that open with a bold and italic term."""
    return blocks.where("lead <> ''").select("path", "ordinal", F.col("lead").alias("term"), definition_body(F.col("text"), F.col("lead")).alias("text"))
