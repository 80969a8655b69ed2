from __future__ import annotations

import random

import pytest

CLASHING = "k string, h string, cls string, hub string, n string, token string, ids string, spans string, tile string, root string, row string, g string, _k string"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("the of and thing ering onth reat hand inst Atle éten ñor,".split()) + str(r.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, near and exact copies, repeated rows, a very long text, shared passages."""
    base, passage = sentence(1, 120), sentence(2, 60)
    near = base.split()
    near[50] = "changed"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, base), (5, base), (6, " ".join(near)), (7, base.upper()), (7, base.upper()), (8, sentence(3, 30) + " " + passage + " " + sentence(4, 30))]
    rows += [(9, sentence(5, 20) + "\n" + passage), (10, passage + " " + passage), (11, "a " * 200), (12, sentence(6, 4)), (13, sentence(6, 4)), (14, sentence(7, 12_000)), (None, base), (None, None), (15, "ü" * 5000), (16, "\x00 \x85 　 x")]
    return rows + [(100 + i, sentence(50 + i, 40 + i)) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    frame = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "src") for i, t in texts], "doc_id bigint, text string, lang string, source string")
    names = [c.split()[0] for c in CLASHING.split(", ")]
    return frame.selectExpr("*", *(f"'x' AS {n}" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
