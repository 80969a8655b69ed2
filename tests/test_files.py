"""Document loads, media, volumes and ids against their rules written out by hand."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

from pyspark.sql import functions as F

from quillspark.functions.text import media_segment, slug
from quillspark.operators import tables as T
from quillspark.operators import versions as V
from quillspark.operators.hierarchy import in_acts
from quillspark.operators.releases import Releases, dataset_stages
from quillspark.sources import docx, files

NAMES = ["Case 1", "a/b:c", "--x--", "", "...", "é_ü-1", "x" * 80, " pad ", "_", "A.B c"]


def own_slug(name):
    cleaned = "".join(c for c in name if c.isalnum() or c in "-_").strip("-_") or "doc"
    return f"set_{cleaned}"[:60]


def test_ids_and_folders(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "v string").select("v", slug(F.lit("set"), F.col("v")), media_segment(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(n, own_slug(n), re.sub(r"[^A-Za-z0-9._-]+", "_", n.strip()) or "document") for n in NAMES]
    assert spark.createDataFrame([(None,)], "v string").select(media_segment(F.col("v"))).first()[0] == "document"


def test_documents_of_a_folder(spark, tmp_path):
    whole = {
        "a.JSON": json.dumps({"id": 7, "title": "", "body": " text\n"}),
        "under_score.json": json.dumps({"body": "b"}),
        "gone.json": json.dumps({"body": "  "}),
        "bad.json": "{",
        "sub/t.one.TXT": "\r\n  \r\n  Title \r\n\r\n first \r\n  second\n",
        "title.md": "only a title\n \n",
        "empty.txt": "",
        "other.csv": "a\nb",
    }
    (tmp_path / "sub").mkdir()
    for name, text in whole.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {tuple(r) for r in files.read_documents(spark, str(tmp_path), "set").collect()}
    assert got == {("set_7", "case", "a", "text"), ("set_under_score", "case", "under score", "b"), ("set_tone", "case", "Title", "first\nsecond")}


def test_a_dataset_is_loaded_whole(spark, tmp_path):
    store = Releases(spark, str(tmp_path / "store"))
    for n, (dataset, texts) in enumerate([("tax", {"a": "T\n" + "w " * 1200, "b": "T\nx"}), ("law", {"a": "L\ny"}), ("tax", {"c": "T\nz"}), ("law", {})], 1):
        source = tmp_path / f"in{n}"
        source.mkdir()
        for name, text in texts.items():
            (source / f"{name}.txt").write_text(text)
        store.load(n, dataset_stages(spark, str(source), dataset, store.tables()))
    ids = lambda v, t, c: sorted(r[0] for r in store.tables(v)[t].select(c).collect())
    assert ids(1, "documents", "id") == ["tax_a", "tax_b"] and ids(1, "chunks", "id") == ["tax_a_chunk_0", "tax_a_chunk_1", "tax_b_chunk_0"]
    assert ids(2, "documents", "id") == ["law_a", "tax_a", "tax_b"]
    # the dataset's own rows and chunks are gone, the other's stay; a folder without documents changes nothing
    assert ids(3, "documents", "id") == ["law_a", "tax_c"] and ids(3, "chunks", "id") == ["law_a_chunk_0", "tax_c_chunk_0"]
    assert ids(4, "documents", "id") == ids(3, "documents", "id") and ids(4, "chunks", "id") == ids(3, "chunks", "id")


def test_media_are_stored_by_content(spark, tmp_path):
    wmf, png = b"\xd7\xcd\xc6\x9a12", b"\x89PNG"
    held = [("Vol 1", "/word/media/i1.PNG", "image/png", png), ("Vol 1", "/word/media/i2.png", "image/png", png), ("Vol 1", "/word/media/i3.wmf", "", wmf), ("v2", "/word/media/raw", None, b"?"), ("v2", "/word/media/x", "image/gif", b"G"), ("v2", "/word/media/y", None, None)]
    kind = "document string, partname string, content_type string, content binary"
    folder = str(tmp_path / "media")
    parsed = lambda *names: spark.createDataFrame([(n,) for n in names], "document string")
    files.store_media(parsed("Vol 1", "v2"), spark.createDataFrame(held, kind), folder, "ACT", lambda data, form: b"made of " + form.encode() if form == "wmf" else None)
    name = lambda data: hashlib.sha1(data).hexdigest()[:16]
    got = {r["relative_path"]: r for r in files.stored_media(spark, folder).collect()}
    assert set(got) == {f"act/Vol_1/{name(png)}.png", f"act/Vol_1/{name(wmf)}.png", f"act/v2/{name(b'?')}.bin", f"act/v2/{name(b'G')}.gif"}
    made = got[f"act/Vol_1/{name(wmf)}.png"]
    assert bytes(made["content"]) == b"made of wmf" and made["converted"] and made["source"] == ".wmf" and made["public_url"] == "/media/" + made["relative_path"]
    assert got[f"act/v2/{name(b'?')}.bin"]["public_url"] is None and not got[f"act/v2/{name(b'G')}.gif"]["converted"]
    # a later load of one volume, without media now, empties its folder alone
    files.store_media(parsed("Vol 1"), spark.createDataFrame([], kind), folder, "ACT")
    assert {r["document"] for r in files.stored_media(spark, folder).collect()} == {"v2"}
    files.store_media(parsed("v2"), spark.createDataFrame([("v2", "a.wmf", "", wmf)], kind), folder, "ACT")
    assert [(r["extension"], r["renderable"]) for r in files.stored_media(spark, folder).collect()] == [(".wmf", False)]


def test_media_of_word_files(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w/>")
        z.writestr("word/media/image1.png", b"1")
        z.writestr("word/media/image2.emf", b"2")
    (tmp_path / "v1.docx").write_bytes(out.getvalue())
    got = sorted((r["document"], r["partname"], bytes(r["content"])) for r in docx.read_media(spark, str(tmp_path)).collect())
    assert got == [("v1", "/word/media/image1.png", b"1"), ("v1", "/word/media/image2.emf", b"2")]


def test_volumes_by_place(spark):
    sources = spark.createDataFrame([(f"f{i:03d}.rtf", str(i)) for i in range(120)] + [("f000.rtf", "0")], "name string, digest string")
    manifest = spark.createDataFrame([("f000.rtf", "0"), ("f001.rtf", "old"), ("f002.rtf", "2"), ("f002.rtf", "2")], "name string, digest string")
    done = spark.createDataFrame([("A05.docx",), ("A06.docx",)], "target string")
    got = sorted(tuple(r) for r in T.paired(sources, manifest, done, 5, 110, "A{}.docx").select("name", "volume", "target", "due").collect())
    assert got == [(f"f{i:03d}.rtf", 5 + i, f"A{5 + i:02d}.docx", i != 0) for i in range(106)]
    assert T.paired(sources.limit(0), manifest, done, 1, 3, "A{}.docx").count() == 0


def test_ids_of_acts(spark):
    ids = spark.createDataFrame([("A",), ("A_1",), ("A_1_2",), ("A_B_3",), ("AB_1",), ("A_1",), (None,), ("",)], "internal_id string")
    acts = spark.createDataFrame([("A",), ("A_B",), ("Z",), (None,), ("A",)], "act_id string")
    assert {tuple(r) for r in in_acts(ids, acts).collect()} == {("A", 4), ("A_B", 1), ("Z", 0)}


def test_a_broken_version_table_is_an_error(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "part-0.parquet").write_bytes(b"broken")
    try:
        V.seed(spark, str(tmp_path / "meta"))
    except Exception:  # noqa: BLE001  any error of the reader
        assert [p.name for p in (tmp_path / "meta").iterdir()] == ["part-0.parquet"]
    else:
        raise AssertionError("a version was made up")
