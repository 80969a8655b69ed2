from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sentence
from quillspark.llm.language_id import identify
from quillspark.llm.ordinal import Ordinal, features, fit, graded, score, select_documents, train


def test_ordinal_separates_held_out_grades(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = sentence(1000 + i, 30 + i % 60).split()
        grade = i % 3
        if grade == 0:
            words.insert(r.randrange(len(words)), r.choice(["stupid", "moron", "lowei" + r.choice(["lo", "sp", "xx"])]))
        if grade == 1:
            words = [w + r.choice(["!!", "%%%"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if grade == 1 else 1, int(grade == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id bigint, quality int, toxic int")
    model = train(docs, graded(seen), n_grades=3)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    right = sum((got[i]["tails"][1] >= 0.5) == (i % 3 == 2) for i in range(0, 900, 4))
    assert right / 225 > 0.95
    assert all(r["tails"][0] >= r["tails"][1] and 0 <= r["expected_grade"] <= 2 for r in got.values())
    again = train(docs, graded(seen), n_grades=3)
    assert (again.weights == model.weights).all()


def likelihood(rows, grades, weights, cuts):
    """Sum of log P(grade) by the definition of the cumulative link."""
    total = 0.0
    for r, g in zip(rows, grades, strict=True):
        z = float(weights[r].sum())
        above = [1.0, *(1 / (1 + math.exp(c - z)) for c in cuts), 0.0]
        total += math.log(above[g] - above[g + 1])
    return total


def test_fit_nears_the_likelihood_of_plain_gradient_ascent():
    """With presence features and no feature selection, FTRL ends near the optimum that slow
    numeric ascent on the definition finds."""
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 6, 3)) for _ in range(300)]
    true = np.array([1.5, -1.0, 0.5, 0.0, -0.5, 1.0])
    z = np.array([true[x].sum() for x in rows]) + r.logistic(size=300)
    grades = (z > 0).astype(int) + (z > 1.5)
    model = fit(rows, grades, 3, 3, epochs=60, l1=0.0, l2=0.01, least=0, deviation=-1.0)
    w, cuts = np.zeros(8), np.array([-0.5, 0.5])

    def slope(f, x):
        out = np.zeros(len(x))
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += 1e-4
            down[i] -= 1e-4
            out[i] = (f(up) - f(down)) / 2e-4
        return out

    for _ in range(150):
        w += 0.01 * slope(lambda v: likelihood(rows, grades, v, cuts), w)
        cuts = np.sort(cuts + 0.01 * slope(lambda c: likelihood(rows, grades, w, c), cuts))
    best = likelihood(rows, grades, w, cuts)
    assert likelihood(rows, grades, model.weights.astype(float), model.thresholds) > 1.03 * best  # both are negative


def test_training_bounds(spark):
    docs = spark.createDataFrame([(i, f"good{i % 5} words " * 20) for i in range(300)] + [(7, "bad words " * 100_000)], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, grade int")
    few = train(docs, ratings, n_grades=2, sample=50, sample_bytes=5000)
    assert np.isfinite(few.weights).all() and score(docs, few).count() == 301
    assert (train(docs, ratings, n_grades=2, sample=10, sample_bytes=10).weights == 0).all()  # nothing fits


def test_scores_by_the_definition(spark):
    model = Ordinal(np.random.default_rng(2).normal(size=1 << 12).astype(np.float32), np.array([-0.5, 0.7]))
    texts = ["One two, two THREE.", "", None, "word " * 50]
    got = score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, bits=12).collect()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        _, found = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 12)
        tails = [1 / (1 + math.exp(c - float(model.weights[found].sum()))) for c in model.thresholds]
        assert r["tails"] == pytest.approx(tails, rel=1e-5) and r["expected_grade"] == pytest.approx(sum(tails), rel=1e-5)


def test_ordinal_edges(spark, docs, empty, texts):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (999, 1, 1), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")
    scored, keep = select_documents(docs, labels)
    assert scored.count() == len(texts) and scored.where(keep).columns[:4] == ["doc_id", "text", "lang", "source"]
    none = labels.limit(0)
    scored, keep = select_documents(docs, none)
    assert scored.where(keep).count() == len(texts)  # nothing is known against any
    assert score(empty, train(empty, graded(labels), n_grades=3)).count() == 0


def test_language_id(spark):
    parts = {"en": "the and thing with that ering", "de": "der und einen schön üben nicht", "fr": "été leçon être que dans où"}
    rows = [(i, " ".join(random.Random(i).choices(parts[lang].split(), k=12)), lang) for i in range(400) for lang in [list(parts)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (1003, "THE AND THING", None), (None, "der und nicht", "de")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert held and sum(got[i]["lang_pred"] == list(parts)[i % 3] for i in held) / len(held) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == 0


def test_language_id_without_training(docs, empty, texts):
    assert identify(empty).count() == 0
    got = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(texts) and {r["lang_pred"] for r in got} == {"und"}


def grams_by_hand(text):
    """Buckets of the 1- to 3-grams with a letter, one character after the other."""
    top, out = 1 << 64, []
    points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 32) for c in text]
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            if all(p == 32 for p in points[i : i + n]):
                continue
            code = 0
            for k in range(n):
                code = (code * 0x100000001B3 + (points[i + k] + k + 1) * 0x9E3779B97F4A7C15) % top
            out.append(((code ^ (code >> 29)) * 0xD6E8FEB86659FD93 % top) >> 50)
    return out


def test_language_id_equals_naive_bayes_by_hand(spark):
    r = random.Random(6)
    words = {"en": ["the", "And", "ering"], "de": ["der", "und", "schön"], "fr": ["été", "que", "leçon"]}
    rows = [(i, " ".join(r.choice(words[lang] + ["x1", "—"]) for _ in range(r.randrange(1, 6))), lang) for i in range(60) for lang in [r.choice(sorted(words))]]
    rows += [(100, "7 8", "en"), (101, None, "de"), (102, "Ünd the", None)]
    counts = {lang: {} for lang in words}
    for i, t, lang in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for g in grams_by_hand(t):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    got = {x["doc_id"]: x for x in identify(spark.createDataFrame([(*x, "z") for x in rows], "doc_id bigint, text string, lang string, n string").repartition(2)).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = {lang: sum(math.log((n.get(g, 0) + 0.5) / (sum(n.values()) + 0.5 * (1 << 14))) for g in grams_by_hand(t)) for lang, n in counts.items()}
        best = max(logs.values())
        posterior = {lang: math.exp(v - best) / sum(math.exp(x - best) for x in logs.values()) for lang, v in logs.items()}
        assert got[i]["score"] == pytest.approx(max(posterior.values()), abs=1e-3)
        assert posterior[got[i]["lang_pred"]] == pytest.approx(max(posterior.values()), abs=1e-3)


def test_languages_in_blocks_equal_one_matrix(spark, monkeypatch):
    from quillspark.llm import language_id

    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["der", "the", "été", "aa", "bb", "x1", "7"]) for _ in range(r.randrange(0, 8))), f"l{r.randrange(7)}") for i in range(120)]
    # two languages that were learnt from the same text tie, whichever blocks they are in
    rows += [(1000 + i, "zz zz", lang) for i, lang in enumerate(["ta", "tz"] * 4) if zlib.crc32(str(1000 + i).encode()) % 4 != 2]
    rows += [(2000, None, "l1"), (2001, "12", "l2"), (None, "zz", None), (2002, "zz", None), (2002, "zz", None)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id bigint, text string, lang string, total string").repartition(3)
    key = lambda x: (str(x["doc_id"]), x["lang_pred"], x["score"])
    want = sorted(identify(docs).collect(), key=key)
    for most in (1, 4):
        got = sorted(identify(docs, most=most).collect(), key=key)
        assert [(x["doc_id"], x["held_out"], x["lang_pred"]) for x in got] == [(x["doc_id"], x["held_out"], x["lang_pred"]) for x in want]
        assert [x["score"] for x in got] == pytest.approx([x["score"] for x in want], abs=1e-9)
    # counts leave a task in parts, and add up to the same
    plain = {tuple(x) for x in language_id.counts(docs).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(language_id)
    try:
        assert {tuple(x) for x in language_id.counts(docs).collect()} == plain
    finally:
        cloudpickle.unregister_pickle_by_value(language_id)
