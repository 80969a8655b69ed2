from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.stemming import STOP, cover_density, lexemes, stem
from quillspark.operators import etl as E


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.fixture(autouse=True)
def column(spark):
    global v  # noqa: PLW0603  a Column needs a session
    v = F.col("v")


@pytest.mark.parametrize(
    ("query", "terms"),
    [("R&D feedstock", ["r&d", "feedstock"]), ("a bb bb ccc", ["bb", "ccc"]), ("one three fourteen fifteen sixteen seventeen eighteen nineteen twenty zz yy xx", None), ("", [])],
)
def test_query_terms(spark, query, terms):
    got = one(spark, X.query_terms(v), query)
    if terms is None:
        words = query.split()
        assert len(got) == 8 and got == sorted(got, key=words.index) and "zz" not in got
    else:
        assert got == terms


def test_snippets(spark):
    assert one(spark, X.snippet(v), "# A *bold* [link]  text") == "A bold link text"
    assert one(spark, X.snippet(v), None) == "No content" and one(spark, X.document_snippet(v), None) == ""
    long = one(spark, X.snippet(v), "word, " * 40)
    assert long.endswith("word…") and len(long) <= 121
    assert one(spark, X.images_to_alt(v), "see ![a chart](x.png) and ![](y.png)") == "see a chart and Image"
    assert one(spark, X.html_escape(v), " <b> ") == "&lt;b&gt;"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("s 6-5 ordinary income", ("ACT", "6-5", ["ordinary income"])),
        ("sec 6.5", ("ACT", "6-5", [])),
        ("6 5", ("ACT", "6-5", [])),
        ("10 dollars", ("ACT", "10-DOLLARS", [])),
        ("ACT section 104-10; gains, losses", ("ACT", "104-10", ["gains", "losses"])),
        ("chapter foo", None),
        ("", None),
    ],
)
def test_citation_tokens(spark, text, want):
    got = one(spark, X.citation_token(v, "ACT", ["ACT"]), text)
    assert (tuple(got) if got else None) == want


def test_natural_order(spark):
    names = ["R10.N2", "r2.N10", "R2.N9", "R2"]
    rows = spark.createDataFrame([(n,) for n in names], "v string").orderBy(X.natural_key(v)).collect()
    assert [r["v"] for r in rows] == ["R2", "R2.N9", "r2.N10", "R10.N2"]


def test_similarity(spark):
    same = one(spark, X.similarity(X.trigrams(v), X.trigrams(F.upper(v))), "income tax")
    none = one(spark, X.similarity(X.trigrams(v), X.trigrams(F.lit(""))), "")
    assert same == 1.0 and none == 0.0


def test_labels(spark):
    assert one(spark, X.path_label(v), "6-5(1)") == "_6_5_1"
    assert one(spark, X.path_label(v), "---").startswith("EMPTY_")
    assert one(spark, X.reference_to_internal(v), "ACT:Section:1/2") == "ACT_Section_1_2"


def test_chunks(spark):
    text = "abcdefghij" * 10
    got = one(spark, X.chunks(v, 12, 4), text)
    assert all(len(c) <= 12 for c in got) and got[0] + "".join(c[4:] for c in got[1:]) == text
    assert one(spark, X.chunks(v), "  ") == []


def test_embedding_chunks():
    text = "word " * 200
    (compat,), (true,) = E.embedding_cuts([text], 100, 30), E.embedding_cuts([text], 100, 30, compat=False)
    assert all(len(c) <= 100 for c in compat + true) and len(true) > len(compat)
    assert E.embedding_cuts(["", "x" * 25, "  ab  "], 10, 0) == [[], ["x" * 10, "x" * 10, "x" * 5], ["ab"]]
    assert E.embedding_cuts(["   " + "abcd efgh " * 3], 12, 4)[0][0] == "abcd efgh"  # cut after the text is stripped
    r = random.Random(2)
    texts = ["".join(r.choice("ab é") for _ in range(r.randrange(60))) for _ in range(50)]
    together = E.embedding_cuts(texts, 9, 3, compat=False)
    for t, chunks in zip(texts, together, strict=True):
        assert E.embedding_cuts([t], 9, 3, compat=False) == [chunks]
        assert all(c == c.strip() and 0 < len(c) <= 9 and c in t for c in chunks)
        assert set("".join(chunks)) == set(t.strip()) - ({" "} - set("".join(chunks)))


def test_packs():
    text = "\n\n".join(["para " * 100] * 30) + "\n\n```\ncode\n\nmore\n```"
    packs = E.pack_blocks(text)
    assert "\n\n".join(packs) == text and any("code\n\nmore" in p for p in packs) and all(len(p) <= 2000 for p in packs)
    assert E.pack_blocks("short") == ["short"]


def test_tagger(spark):
    terms = ["car", "car park", "x", "policy", "R&D", "knife", "half", "box"]
    texts = ["Cars in a car  park", "[car](link) policies, scar x r&d", "knives halves boxes", "knifes halfs boxs policys"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["terms"] for r in E.tag_terms(docs, terms, loose=True).collect()}
    assert got == {0: "car,car park", 1: "R&D,policy", 2: "box,half,knife", 3: ""}


#: Words of the sample vocabulary that was published with the algorithm, and their stems.
SAMPLE = {
    "consign": "consign consigned consigning consignment", "consist": "consist consisted consistency consistent consistently consisting consists", "consol": "consolation consolations console consoled consoles consoling consolingly consols",
    "consolatori": "consolatory", "consolid": "consolidate consolidated consolidating", "conson": "consonant", "consort": "consort consorted consorting", "conspicu": "conspicuous conspicuously", "conspiraci": "conspiracy",
    "conspir": "conspirator conspirators conspire conspired conspiring", "constabl": "constable constables", "constanc": "constance constancy", "constant": "constant", "knack": "knack knacks", "knackeri": "knackeries", "knag": "knag",
    "knave": "knave knaves", "knavish": "knavish", "knead": "kneaded kneading", "knee": "knee knees", "kneel": "kneel kneeled kneeling kneels", "knight": "knight knightly knights", "knit": "knit knits knitted knitting", "knock": "knock knocked knocking knocks", "knocker": "knocker knockers", "knot": "knot knots",
    "sky": "sky skies", "die": "dying", "onli": "only", "news": "news", "generat": "generate", "generic": "generic", "communic": "communication", "succeed": "succeed", "happi": "happy", "say": "say", "hope": "hoping", "hop": "hopping", "apolog": "apology", "control": "controll",
}


def test_stems_of_the_published_sample():
    assert {w: stem(w) for words in SAMPLE.values() for w in words.split()} == {w: s for s, words in SAMPLE.items() for w in words.split()}
    assert len(STOP) == 127 and lexemes("The dogs of war") == [None, "dog", None, "war"]


def test_stems_and_covers():
    assert [stem(w) for w in ("ponies", "cats", "hopping", "agreed", "happy", "sing")] == ["poni", "cat", "hop", "agre", "happi", "sing"]
    assert lexemes("The cats, and the hat") == [None, "cat", None, None, "hat"]
    near, far = cover_density(["a", "b", "x"], ["a", "b"]), cover_density(["a", "x", "x", "b"], ["a", "b"])
    assert near == pytest.approx(0.1) and far == pytest.approx(0.1 / 3) and cover_density(["a"], ["a", "b"]) == 0
    assert cover_density(["a", "b", "b", "c"], ["a", "b", "c"]) == pytest.approx(0.1)  # a repeated query word is no other word
    assert cover_density(["a"], [None]) == 0


def test_heading_labels(spark):
    def f(kind, title, local=None, ref=None):
        row = spark.createDataFrame([(kind, title, local, ref)], "k string, t string, l string, r string")
        h = row.select(X.heading_label(F.col("k"), F.col("t"), F.col("l"), F.col("r")).alias("h")).first()["h"]
        return h["label"], h["heading"], h["variants"]

    assert f("Section", "Ordinary income", "6-5") == ("Section 6-5", "Section 6-5 — Ordinary income", ["Section 6-5", "section 6-5", "Sect 6-5", "sect 6-5", "s 6-5"])
    assert f("Part", "Part IV stays", None, "ACT:Part:IV") == ("Part IV", "Part IV stays", ["Part IV", "part IV", "Pt IV", "pt IV", "ACT:Part:IV"])
    assert f("Schedule:1:Part", "Rates", "2")[:2] == ("Schedule 1 Part 2", "Schedule 1 Part 2 — Rates") and "sch 1 pt 2" in f("Schedule:1:Part", "Rates", "2")[2]
    assert f("Schedule:2", "")[2] == ["Schedule 2", "schedule 2", "Sch 2", "sch 2"]
    assert f("Chapter", None) == ("Chapter", "Chapter", ["Chapter", "chapter"])
    assert f("Act", "The Act") == ("The Act", "The Act", ["The Act", "Act"])
    assert f("Definition", "car", None, "ACT:Definition:car") == ("car", "car", ["car", "ACT:Definition:car"])
    assert f(None, None) == ("Provision", "Provision", ["Provision"])


def test_structured_references(spark):
    got = [(r["kind"], r["value"]) for r in one(spark, X.structured_references(v), "see s 6-5, div 7A, Subdivision 115-A, Part IV and ACT: Section : 9-1")]
    assert got == [("Section", "6-5"), ("Division", "7A"), ("Subdivision", "115-A"), ("Part", "IV"), ("RefId", "ACT:Section:9-1"), ("LocalId", "6-5"), ("LocalId", "115-A"), ("LocalId", "9-1")]


def test_headings(spark):
    def f(title, level):
        return tuple(one(spark, E.sectioned(v, F.lit(level)), title))

    assert f("Division 40—Capital", 3) == ("Division", "40", "Capital") and f("SUBDIVISION 115-A", 4) == ("Subdivision", "115-A", "")
    assert f("6-5 Ordinary income", 5) == ("Section", "6-5", "Ordinary income")
    assert f("6-5 Ordinary income", 4) == ("Level4Element", None, "6-5 Ordinary income")  # sections have a level of their own
    assert f("Schedule 1 Things", 2) == ("Level2Element", None, "Schedule 1 Things") and f("Division 40 of it", 3)[0] == "Level3Element"
    assert f("Division 40—Capital", 5) == ("Section", "Division", "40—Capital")  # where the first word is the id
    assert f("Guide to Division 1", 3)[0] == "Guide" and f("Operative provisions", 5)[0] == "OperativeProvision" and f("Anything", 1)[0] == "Level1Element"


def test_salvage(spark):
    def f(text):
        return [r["ref_id"] for r in one(spark, E.salvaged(v, "ref_id string"), text)]

    assert f('[{"ref_id": "a"}, {"ref_id": "b"}]') == ["a", "b"] and f('[{"ref_id": "a"}, {"ref') == ["a"] and f("nothing") == []
