from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.textkit import gram_hashes, window_min, word_slices

text = st.one_of(st.text(alphabet=" \t\nabcAB.é　", max_size=40), st.text(alphabet=" ab", min_size=30, max_size=60))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=6), st.sampled_from([1, 8, 1000]))
def test_words_and_hashes(texts, limit):
    got, seen = [], {}
    for a, b, words in word_slices(pa.array(texts, pa.string()), limit):
        raw = words.data.tobytes()
        hashes, codes = words.hashes(lower=True), words.codes(lower=True)
        numbers = {}
        for i in range(b - a):
            own = range(words.first[i], words.first[i + 1])
            got.append([raw[words.start[j] : words.end[j]] for j in own])
            for j in own:
                assert seen.setdefault(raw[words.start[j] : words.end[j]].lower(), hashes[j]) == hashes[j]
                assert numbers.setdefault(raw[words.start[j] : words.end[j]].lower(), codes[j]) == codes[j]
        assert len(set(numbers.values())) == len(numbers)
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_long_words():
    stem = "x" * 300
    texts = [stem + "a" + stem, stem + "b" + stem, "y" * 8, "y" * 8 + "\0", "y\0", "y", stem + "a" + stem, "abcdefghijklmnop", "abcdefgh_jklmnop"]
    ((_, _, words),) = word_slices(pa.array([" ".join(texts)]))
    for numbers in (words.hashes(), words.codes()):
        assert numbers[0] == numbers[6] and len(set(numbers.tolist())) == len(texts) - 1


def test_grams_depend_on_order_and_place_does_not_matter():
    words = np.array([5, 6, 7, 5, 6, 7, 6], np.uint64)
    g = gram_hashes(words, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4
    values = np.random.default_rng(0).integers(0, 99, 50)
    assert window_min(values, 7).tolist() == [values[i : i + 7].min() for i in range(44)]
