"""The registry against one pattern of all terms, as the rules state it."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import fallback_markers, plural_variants
from quillspark.operators import load as L
from quillspark.operators.registry import Trie, settled, tagged, used


def by_pattern(spark, terms, texts):
    """(held, marked) of each text: alternations in order of length, outside of links for what is held."""
    terms = sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t))
    plurals = {r["term"]: r["v"] for r in spark.createDataFrame([(t,) for t in terms], "term string").select("term", plural_variants(F.col("term")).alias("v")).collect()}
    meant = {}
    for t in terms:
        if len(re.sub("[^A-Za-z0-9]", "", t)) >= 2:
            for v in plurals[t]:
                meant.setdefault(v.lower(), t)
    held = re.compile("(?<![A-Za-z0-9])(" + "|".join(map(re.escape, meant)) + ")(?![A-Za-z0-9])", re.I)
    marked = re.compile(r"(?:^|[\s\(])\*(?P<term>" + "|".join(map(re.escape, terms)) + r")(?=[\s,.;:)]|$)", re.I)
    out = []
    for text in texts:
        found = {m["term"].strip() for m in marked.finditer(text or "")}
        for piece in re.split(r"\[[^\]]+\]\([^\)]+\)", text or ""):
            found |= {meant[m[1].lower()] for m in held.finditer(piece)}
        out.append(sorted(found))
    return out


def run(spark, terms, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = tagged(rows, spark.createDataFrame([(t,) for t in terms], "term string"), **options).collect()
    return [r["terms"] for r in sorted(got, key=lambda r: r["id"])]


@pytest.mark.parametrize(
    ("terms", "text", "want"),
    [
        (["income tax", "tax"], "Income tax applies alongside fringe benefits legislation.", ["income tax"]),
        (["tax offset"], "Eligible Tax Offsets can reduce liability.", ["tax offset"]),
        (["tax offset"], "Refer to [tax offset](#link) and note that the tax offset applies.", ["tax offset"]),
        (["tax offset"], "Refer to [tax offset](#link) only.", []),
        (["A", "B", "tax"], "A taxpayer pays tax under this Act.", ["tax"]),
        (["A", "car"], "(*A and *Car, not 2*car nor *cart", ["A", "Car", "car"]),
        (["car limit", "car"], "*car limit", ["car limit"]),
        (["car"], "", []),
        (["car"], None, []),
    ],
)
def test_rules(spark, terms, text, want):
    assert run(spark, terms, [text]) == [want]


def test_equal_to_one_pattern_in_one_part_and_in_many(spark):
    rng = random.Random(5)
    words = ["tax", "car", "income", "a", "x", "limit", "policy", "half", "loss", "box)", "R&D", "non-resident", "é", "tax-free"]
    terms = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    signs = [" ", " ", " ", "  ", "\n", " *", " (*", ". ", ") ", "-", "[", "](u) ", "(", ", ", "s ", "es "]
    texts = ["".join(rng.choice([str.upper, str.lower, str])(rng.choice(words)) + rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += [texts[0], "", None, "*tax", "tax", " ".join(terms), "*" + " *".join(terms)]
    want = by_pattern(spark, terms, texts)
    assert sum(map(len, want)) > 500
    assert run(spark, terms, texts) == want
    assert run(spark, terms, texts, most_bytes=2000) == want


def test_no_terms_leaves_what_is_marked(spark):
    texts = ["*Asset and (*non-cash benefit), not 2*3 *", "* item", "none", "*a(b)c; *x*y *é"]
    assert run(spark, [], texts) == [["Asset", "non-cash"], ["item"], [], ["a(b"]]
    assert run(spark, [None, " "], ["*Asset"]) == [["Asset"]]
    pattern = re.compile(r"(?:^|[\s\(])\*(?P<term>[a-zA-Z0-9\s\-\(\)]+?)(?=[\s,.;:)]|$)")
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(F.array_sort(fallback_markers(F.col("v")))).collect()
    assert [r[0] for r in rows] == [sorted({m["term"].strip() for m in pattern.finditer(t)} - {""}) for t in texts]


def test_rows_are_kept_and_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, "tax", "q"), (1, "tax", "q"), (None, "car tax", "q")], "id bigint, text string, terms string")
    terms = spark.createDataFrame([("tax", 1), ("tax", 2), ("car", 3), (None, 4)], "term string, id int")
    assert sorted((str(r["id"]), r["terms"]) for r in tagged(rows, terms).collect()) == [("1", ["tax"]), ("1", ["tax"]), ("None", ["car", "tax"])]
    assert sorted((str(r["id"]), r["term"]) for r in used(rows, terms).collect()) == [("1", "tax"), ("None", "car"), ("None", "tax")]
    assert tagged(rows.limit(0), terms).count() == 0


def test_a_hundred_thousand_terms(spark):
    terms = [(f"term {i} of {i % 97}", f"term {i} of {i % 97}", True, -20) for i in range(100_000)]
    trie = Trie(terms)
    assert settled(trie.spans("a Term 99999 of 89 and term 5 of 5, term 5 of 55, *term 7 of 7")) == {"term 99999 of 89", "term 5 of 5", "term 7 of 7"}


def test_a_load_marks_terms_of_many_words(spark):
    nodes = spark.createDataFrame([("n1", "The *car limit, cars and [car](x)"), ("n2", "*Unknown word and income"), ("n3", None)], "internal_id string, content_md string")
    defined = spark.createDataFrame([("car limit",), ("car",), ("income",)], "term string")
    assert {tuple(r) for r in L.terms_used(nodes, defined).collect()} == {("n1", "car limit"), ("n1", "car"), ("n2", "income")}
    assert {tuple(r) for r in L.terms_used(nodes, defined.limit(0)).collect()} == {("n1", "car"), ("n2", "Unknown")}
