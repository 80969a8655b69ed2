from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import load as L
from quillspark.operators import relations as R
from quillspark.operators import vectors as V
from quillspark.operators.etl import embedding_cuts
from quillspark.operators.tables import Kept
from quillspark.sources import docx
from tests.test_ingest import document, paragraph


def test_load_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = [paragraph("Chapter 1—Start", "H1"), paragraph("6-5 Ordinary", "H5"), paragraph("See section 6-10 and *income of 1997."), paragraph(" means: money", lead="income")]
    two = [paragraph("6-10 Other", "H5"), paragraph("Section 6-5 and section 99-1 say so.")]
    (tmp_path / "in" / "v1.docx").write_bytes(document(*one))
    (tmp_path / "in" / "v2.docx").write_bytes(document(*two))
    stage = str(tmp_path / "stage")
    L.parse_volumes(spark, str(tmp_path / "in"), stage)
    L.parse_volumes(spark, str(tmp_path / "in"), stage)
    assert L.read_stage(spark, stage).count() == 4

    def call(text: str) -> str:
        return json.dumps([{"ref_id": f"Section:{m}", "snippet": f"section {m}"} for m in re.findall(r"ection (\d+-\d+)", text)])

    out = L.load_act(spark, stage, "ACT", call=call, model="m")
    rows = {r["ref_id"]: r for r in out.provisions.collect()}
    assert set(rows) == {"ACT:Chapter:1", "ACT:Section:6-5", "ACT:Section:6-10", "ACT:Definition:income"}
    assert rows["ACT:Section:6-5"]["parent_internal_id"] == "ACT_Chapter_1" and rows["ACT:Section:6-10"]["parent_internal_id"] is None
    assert rows["ACT:Definition:income"]["content_md"] == "money" and rows["ACT:Definition:income"]["parent_internal_id"] == "ACT_Section_6-5"
    assert (rows["ACT:Section:6-5"]["in_degree"], rows["ACT:Section:6-10"]["out_degree"]) == (1, 2)
    assert abs(out.provisions.agg(F.sum("pagerank")).first()[0] - 1) < 0.5
    found = {(r["source_internal_id"], r["target_ref_id"], r["target_internal_id"]) for r in out.references.collect()}
    assert found == {("ACT_Section_6-5", "ACT:Section:6-10", "ACT_Section_6-10"), ("ACT_Section_6-10", "ACT:Section:6-5", "ACT_Section_6-5"), ("ACT_Section_6-10", "ACT:Section:99-1", None)}
    assert ("ACT_Section_6-5", "income", "ACT_Definition_income") in {tuple(r) for r in out.terms.collect()}
    assert [r["normalized_reference"] for r in out.log.collect()] == ["ACT:Section:99-1"]
    for _ in range(2):
        L.store(out, str(tmp_path / "store"), 3, "ACT")
    assert spark.read.parquet(str(tmp_path / "store" / "provisions")).count() == 4
    log = spark.read.option("header", True).csv(str(tmp_path / "store" / "unresolved_internal_references_ACT"))
    assert log.columns == ["source_node_ref_id", "original_reference", "normalized_reference", "snippet"]


def test_settling_states_each_case(spark):
    nodes = spark.createDataFrame([("ACT_Section_1-1", "ACT:Section:1-1", "Section", "a", None), ("ACT_Section_2-1", "ACT:Section:2-1", "Section", None, "x")], "internal_id string, ref_id string, type string, title string, content_md string")
    raw = [("ACT_Section_1-1", 0, "section 1-1", None), ("ACT_Section_1-1", 1, "n/a", "s"), ("ACT_Section_1-1", 2, None, "s"), ("ACT_Section_1-1", 3, "section 9-9", "b"), ("ACT_Section_2-1", 0, "section 9-9", "a"), ("nowhere", 0, "section 1-1", "")]
    settled = L.settle(nodes, spark.createDataFrame(raw + raw[3:4], L.RAW), "ACT")
    out = L.payloads(nodes, settled, spark.createDataFrame([("ACT_Section_1-1", ""), ("ACT_Section_1-1", "no such")], "source_internal_id string, term_text string"), "ACT", ranked=False)
    assert out.references.count() == 3
    assert {(r["internal_id"], r["title"], r["in_degree"], r["out_degree"]) for r in out.provisions.collect()} == {("ACT_Section_1-1", "a", 0, 2), ("ACT_Section_2-1", "Unnamed Provision", 0, 1)}
    assert sorted(tuple(r) for r in out.log.collect()) == [("ACT:Section:1-1", "n/a", L.FAILED, "s"), ("ACT:Section:1-1", "section 9-9", "ACT:Section:9-9", "b")]
    assert [tuple(r) for r in out.terms.collect()] == [("ACT_Section_1-1", "no such", None)]
    empty = L.payloads(nodes.limit(0), settled.limit(0), out.terms.limit(0).select("source_internal_id", "term_text"), "ACT")
    assert [t.count() for t in (empty.provisions, empty.references, empty.terms, empty.log)] == [0, 0, 0, 0]


def split_by_hand(text, items):
    items = sorted(items, key=lambda i: (-len(i[0]), i[1] == "term", i[2]))
    body = "|".join(re.escape(i[0]) for i in items)
    if not body:
        return [(text, "plain", None)]
    out = []
    for k, part in enumerate(re.split(rf"((?<!\w)(?:{body})(?!\w))", text, flags=re.I | re.A)):
        if part:
            hit = next((i for i in items if k % 2 and i[0].lower() == part.lower()), None)
            out.append((part, hit[1], hit[2]) if hit else (part, "plain", None))
    return out


def test_tokenised_equals_a_split_by_hand(spark):
    items = [("section 6-5", "ref", "A:Section:6-5"), ("section 6", "ref", "A:Section:6"), ("car", "term", "A_Definition_car"), ("*car*", "term", "A_Definition_car"), ("a.b (c)", "external", "B Section 1"), ("CAR", "ref", "A:Section:9")]
    texts = ["Section 6-5, section 6 and section 67", "*car* cars CAR car", "axb (c) a.b (c)", "", None, "nothing here", "car"]
    nodes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "internal_id string, text string")
    rows = spark.createDataFrame([(f"n{i}", *x) for i in range(6) for x in items], "internal_id string, text string, kind string, target string")
    got = R.tokenised(nodes, rows.union(rows)).orderBy("internal_id", "place").collect()
    for i, text in enumerate(texts):
        mine = [(r["text"], r["kind"], r["target"]) for r in got if r["internal_id"] == f"n{i}"]
        assert mine == (split_by_hand(text, items if i < 6 else []) if text else [])


def test_clickables_by_kind(spark):
    p = spark.createDataFrame([("A_S_1", "A", "A:S:1", "one", ""), ("A_S_2", "A", "A:S:2", "two", "")], "internal_id string, act_id string, ref_id string, title string, content_md string")
    refs = spark.createDataFrame([("A_S_1", "A:S:2", "A_S_2", "section 2"), ("A_S_1", "A:S:3", None, "section 3"), ("A_S_1", "B:S:4-1", None, "section 4"), ("A_S_1", "B:S:5", None, None)], "source_internal_id string, target_ref_id string, target_internal_id string, snippet string")
    terms = spark.createDataFrame([("A_S_1", "car", "A_S_2"), ("A_S_1", "bus", None)], "source_internal_id string, term_text string, definition_internal_id string")
    got = {tuple(r)[1:] for r in R.clickables(refs, terms, p).collect()}
    assert got == {("section 2", "ref", "A:S:2"), ("section 4", "external", "B S 4 1"), ("car", "term", "A_S_2"), ("*car*", "term", "A_S_2")}


def test_embeddings_equal_their_definition(spark):
    rows = [("a", "Title", "word " * 1200), ("b", None, None), ("c", " x ", "y\n"), ("d", "same", "same")]
    p = spark.createDataFrame(rows, "internal_id string, title string, content_md string")
    got = {r["entity_id"]: r for r in V.embed(p.union(p), V.hashed_words, "m").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    encode = V.hashed_words()
    for key, title, body in rows:
        text = f"{(title or '').strip()}\n{(body or '').strip()}".strip()
        v = encode(embedding_cuts([text])[0] or [""])
        v = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
        m = v.mean(axis=0)
        assert np.allclose(got[key]["vector"], m / (np.linalg.norm(m) or 1), atol=1e-6) and got[key]["dim"] == 64
    old = spark.createDataFrame([("provision", "a", "m", 1, [0.5], 1.0), ("provision", "z", "m", 1, [0.5], 1.0)], "entity_kind string, entity_id string, model string, dim int, vector array<float>, l2_norm double")
    new = {r["entity_id"]: r["dim"] for r in V.refresh(old, p, V.hashed_words, "m").collect()}
    assert new == {"a": 64, "b": 64, "c": 64, "d": 64, "z": 1}
    told = spark.createDataFrame([("k", 0, "q")], "key string, place int, text string")
    seen = V.encoded(told, lambda: lambda texts: np.array([[float(t == "Instruct: find\nQuery:q"), 0.0] for t in texts]), instruction="find").first()
    assert seen["embedding"] == [1.0, 0.0]


def test_conversion_is_skipped_when_done(spark, tmp_path):
    old, new = tmp_path / "docx", tmp_path / "rtf"
    old.mkdir(), new.mkdir()
    (new / "v1.rtf").write_bytes(b"{rtf one}")
    (new / "v2.rtf").write_bytes(b"{rtf two}")
    done = document(paragraph("Done", "H1"))
    (old / "v1.docx").write_bytes(done)
    made = document(paragraph("Made", "H1"))
    blocks = docx.blocks_of(docx.converted(spark, str(new), str(old), lambda content: made))
    assert sorted(r["title"] for r in docx.sections(blocks).collect()) == ["Done", "Made"]


def test_definition_bodies(spark):
    rows = [("income: all", "income"), ("Income means: x", "income"), ("income — y", "income"), ("other", "income"), ("income", "income")]
    got = spark.createDataFrame(rows, "t string, l string").select(docx.definition_body(F.col("t"), F.col("l"))).collect()
    assert [r[0] for r in got] == ["all", "x", "y", "other", ""]


def test_two_versions_stay(spark):
    built = []
    kept = Kept(lambda v: built.append(v) or spark.range(v))
    assert [kept.at(v).count() for v in (1, 2, 1, 3, 3, 1)] == [1, 2, 1, 3, 3, 1]
    assert built == [1, 2, 3, 1]


def test_embeddings_shuffle_texts_only(spark):
    """A text's chunks and their components stay in a task: the one exchange drops rows of the same key."""
    p = spark.createDataFrame([("a", "Title", "word " * 1200), ("b", None, None)], "internal_id string, title string, content_md string")
    plan = V.embed(p, V.hashed_words, "m")._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and V.embed(p.where("false"), V.hashed_words, "m").count() == 0
    executed = V.embed(p, V.hashed_words, "m")._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange ") == 1
