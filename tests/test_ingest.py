from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.operators.ingest import extract, flatten, resolve
from quillspark.plans.api import Corpus
from quillspark.sources import docx, files, model

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, num=None, level=0, lead=None, indent=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "") + (f'<w:ind w:left="{indent}"/>' if indent else "")
    first = f"<w:r><w:rPr><w:b/><w:i/></w:rPr><w:t>{lead}</w:t></w:r>" if lead else ""
    return f"<w:p><w:pPr>{props}</w:pPr>{first}<w:r><w:t>{text}</w:t></w:r></w:p>"


def document(*blocks):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(blocks)}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="ActHead 1"/></w:style><w:style w:styleId="H5"><w:name w:val="ActHead 5,s"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>')
    return raw.getvalue()


def test_docx_sections(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    blocks = [paragraph("Chapter 1", "H1"), paragraph("skip", "Header"), paragraph("Intro text"), paragraph("Bullet 1", num=1), paragraph("Bullet nested", num=1, level=1), paragraph("Bullet 2", num=1), paragraph("Number 1", num=2), paragraph("Number nested", num=2, level=1), paragraph("Outro text"), paragraph("6-5 Income", "H5"), paragraph(" means: money", lead="income", indent=1440), table]
    (tmp_path / "v.docx").write_bytes(document(*blocks))
    read = docx.read_blocks(spark, str(tmp_path))
    rows = docx.sections(read).orderBy("ordinal").collect()
    assert [(r["level"], r["title"]) for r in rows] == [(1, "Chapter 1"), (5, "6-5 Income")]
    assert rows[0]["content_md"] == "Intro text\n\n- Bullet 1\n    - Bullet nested\n- Bullet 2\n\n1. Number 1\n    1. Number nested\n\nOutro text\n\n"
    assert rows[1]["content_md"] == "        income means: money\n\n\n| a |  |\n|---|---|\n| b |  |\n\n"
    found = docx.definitions(read).collect()
    assert [(r["term"], r["text"]) for r in found] == [("income", "money")]


def test_orphan_level_is_clamped():
    assert docx.Lists().item("Orphan nested", "2", 1, True, False) == "1. Orphan nested\n"
    assert docx.indentation(90.0) == "        " and docx.indentation(9999) == " " * 32 and docx.ignored("toc 3") and not docx.ignored(None)


def test_documents_and_media(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"id": "Case 1", "title": "T", "doc_type": "case", "body": "text"}')
    (tmp_path / "d" / "b.txt").write_text("\n\nFirst line\nthe body\n")
    (tmp_path / "d" / "c.md").write_text("only a title")
    got = {r["id"]: (r["doc_type"], r["title"], r["body"]) for r in files.read_documents(spark, str(tmp_path / "d"), "set").collect()}
    assert got == {"set_Case1": ("case", "T", "text"), "set_b": ("case", "First line", "the body")}
    (tmp_path / "m").mkdir()
    for name, data in (("x.bin", b"\xd7\xcd\xc6\x9a1"), ("y.dat", b"\xd7\xcd\xc6\x9a1"), ("z.emf", b"1"), ("w.png", b"2"), ("q.bin", b"0" * 40 + b" EMF")):
        (tmp_path / "m" / name).write_bytes(data)
    media = files.read_media(spark, str(tmp_path / "m")).collect()
    assert sorted(str(r["format"]) for r in media) == ["None", "emf", "emf", "wmf"]
    assert files.read_config(str(tmp_path / "none"))["acts"] == []
    config = {"acts": [{"id": "A", "exclusions": {"ref_ids": ["A:Section:1/2"]}}]}
    assert files.exclusions(config, "A") == ["A_Section_1_2"] and files.exclusions(config, "B") == []


def test_flatten_and_resolve(spark):
    rows = [("c1", None, 0, 0, "A:Chapter:1", "Chapter", "One"), ("c2", None, 0, 1, "A:Chapter:2", "Chapter", "Two"), ("c3", None, 1, 0, "A:Chapter:3", "Chapter", "Three"), ("d", "c1", 0, 0, "A:Division:6-5", "Division", "Div"), ("g", "d", 0, 0, None, "Guide", "Guide to it")]
    nodes = spark.createDataFrame([(*r, "text") for r in rows], "node_id string, parent_node_id string, batch int, ordinal int, ref_id string, type string, title string, content_md string")
    flat = flatten(nodes)
    got = {r["title"]: r for r in flat.collect()}
    assert [got[t]["sibling_order"] for t in ("One", "Two", "Three")] == [0, 1, 2]
    assert got["Div"]["path"] == "_1._6_5" and got["Div"]["parent_internal_id"] == "A_Chapter_1" and got["Div"]["level"] == 2
    guide = got["Guide to it"]
    assert guide["internal_id"].startswith("A_Division_6-5_Element_Guide_to_it_") and guide["ref_id"] == guide["internal_id"] and guide["path"].startswith("_1._6_5.")
    refs = spark.createDataFrame([("A_Chapter_1", "A:Division:6-5", "s"), ("A_Chapter_1", "A:Division:6-5", "s"), ("A_Chapter_1", "B:Part:1", "t"), ("x", None, "")], "source_internal_id string, target_ref_id string, snippet string")
    resolved, lost = resolve(refs, flat)
    assert {(r["target_ref_id"], r["target_internal_id"]) for r in resolved.collect()} == {("A:Division:6-5", "A_Division_6-5"), ("B:Part:1", None)}
    assert [tuple(r) for r in lost.collect()] == [("A_Chapter_1", "B:Part:1", 1, "t")]


def test_cached_extraction(spark):
    texts = spark.createDataFrame([("see section 5 please",), ("see section 5 please",), ("see the Act of 1999",), ("nothing of interest",), ("part",)], "text string")
    cache = spark.createDataFrame([], "hash string, model string, response string")
    got, cache = extract(texts, cache, "m", lambda t: t.upper())
    assert {r["response"] for r in got.collect()} == {"SEE SECTION 5 PLEASE", "SEE THE ACT OF 1999"} and cache.count() == 2

    def never(text: str) -> str:
        raise AssertionError(text)

    again, cache = extract(texts, cache, "m", never)
    assert again.count() == 2 and cache.count() == 2


@pytest.fixture(scope="module")
def corpus(spark):
    sf = "/root/testdata/sf0.001"
    p, refs, terms = model.provisions(spark, sf).cache(), model.references(spark, sf).cache(), model.term_usage(spark, sf).cache()
    graph = G.Mixed.of(p, refs, terms)
    pi = G.power_iteration(graph, 0.5, 3)
    docs = model.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), "text")
    return Corpus(p, refs, terms, graph, pi, docs)


def test_routes(corpus):
    some = corpus.terms.where("definition_internal_id IS NOT NULL").orderBy("source_internal_id").first()
    node = some["source_internal_id"]
    assert corpus.acts().count() == 5 and corpus.hierarchy("R0").count() == 1 and corpus.hierarchy("R0", "R0").first()["has_children"] is not None
    assert [r["ancestor_id"] for r in corpus.breadcrumbs(node).collect()][0] == node.split("_")[0]
    got = {r["internal_id"]: r for r in corpus.detail(node, "missing", fields=["title"]).collect()}
    assert got[node]["error"] is None and got["missing"]["error"] == "Provision not found: missing" and got[node]["etag"]
    assert corpus.references_of(node).count() > 0 and corpus.by_ref_id("R0:Act:0", "R0").count() == 1
    text = corpus.export_markdown(node).first()["markdown"]
    assert text.startswith("## Copied Nodes\n\n### Order") and "## Referenced Nodes" in text
    assert corpus.visible_markdown("R0", node).count() == 2
    hits = corpus.unified_search("supplier means", k=5).collect()
    assert 0 < len(hits) <= 5 and hits == sorted(hits, key=lambda r: -r["urs"]) and hits[0]["next_offset"] == 5
    assert corpus.unified_search("supplier means", k=5, act_id="R0").first()["act_id"] == "R0"
    full = corpus.full_detail(node)
    assert set(full) == {"provision", "references_to", "referenced_by", "definitions", "definition_references", "children", "breadcrumbs"} and full["definitions"].count() > 0
    assert set(corpus.full_detail("R0", references=False, definitions=False, breadcrumbs=False)) == {"provision", "children"}
    needed = [r["part"] for r in corpus.visible_with_definitions(node).collect()]
    assert needed[0] == "shown" and len(needed) > 1 and set(needed[1:]) == {"definition"}
    page = corpus.search_markdown("supplier means", 3).first()["markdown"]
    assert page.startswith("### Query interpretation") and "**3. " in page and "**4. " not in page
    assert corpus.detail_markdown(node).first()["markdown"].startswith("## Order")
    assert corpus.search_documents("tion", 5).count() == 5 and corpus.capabilities().count() > 10
    assert corpus.search_documents(" ", 3).first()["total"] > 3
