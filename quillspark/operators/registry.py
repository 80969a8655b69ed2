"""Defined terms in texts, by a registry: pass 1 gathers what is defined, pass 2 walks one trie of it over every text.

A term is *held* by a text where it, or its plural, stands between signs that are no ASCII letters or digits, outside of
markdown links; of what begins at one place the longest term counts, and what is taken isn't looked at again.
It is *marked* where an asterisk behind the start, a blank or a parenthesis precedes it and a blank, a stop or the end follows;
marked terms are given as the text writes them.  Terms with fewer than two letters or digits are found by marks only.

The trie (an automaton over all forms) finds every form in one pass over a text, whatever their number; the boundaries, the links and
what is taken are masks over what it found.  Forms go to tasks in parts of at most `most_bytes`: one part for what
an act defines, and beyond that a pass a part that adds its places to each text's row, with the same result.

Defined cases: null or empty texts hold nothing; null or blank terms are none; of terms that share a form the longest, then the
first by name, has it; repeated rows give one row each text and term; without terms any word behind an asterisk is marked.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import fallback_markers, plural_variants
from quillspark.operators.tables import saved

# Links, and the signs that end a marked term.
LINK = re.compile(r"\[[^\]]+\]\([^)]+\)")
ENDS = ",.;:)"
FORMS_BYTES = 48 << 20

Span = tuple[str, int, int, int, str]
NAMES = ("kind", "start", "stop", "rank", "term")
PLACE = "struct<kind: string, start: bigint, stop: bigint, rank: bigint, term: string>"


def lowered(text: str) -> str:
    """`text` in lower case, sign by sign, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def forms_of(terms: DataFrame) -> DataFrame:
    """(form, held, marked, order, bytes) of terms (term): each lower-cased form with the term that it stands for where it is held, and
    whether it can be marked.  `order` is the term's length and which of its forms it is: at one place the least comes first."""
    named = terms.where("term IS NOT NULL AND trim(term) <> ''").select(F.regexp_replace("term", r"^\s+|\s+$", "").alias("term")).distinct()
    held = named.where(F.length(F.regexp_replace("term", "[^A-Za-z0-9]", "")) >= 2).select("term", F.posexplode(plural_variants(F.col("term"))).alias("variant", "form"))
    either = held.select(F.lower("form").alias("form"), "term", "variant", F.lit(False).alias("mark")).union(named.select(F.lower("term"), "term", F.lit(0), F.lit(True)))
    rank = F.struct((-F.length("term")).alias("n"), "term", "variant")
    first = F.min(F.when(~F.col("mark"), rank))
    rows = either.groupBy("form").agg(first.alias("first"), F.bool_or("mark").alias("marked"))
    order = (-F.col("first.n")).cast("long") * 2 + (1 - F.col("first.variant"))
    return rows.select("form", F.col("first.term").alias("held"), "marked", F.coalesce(-order, F.lit(0)).alias("order"), (F.octet_length("form") + 64).alias("bytes"))


class Trie:
    """The forms of one part: (form, held, marked, order)."""

    def __init__(self, forms: Iterable[tuple[str, str | None, bool, int]], loose: bool = False) -> None:
        self.loose, self.automaton = loose, ahocorasick.Automaton()
        for form, held, marked, order in forms:
            form = lowered(re.sub(r"\s+", " ", form) if loose else form)
            self.automaton.add_word(form, (len(form), held, marked, order))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All places where a form may be held or marked."""
        if not text or not len(self.automaton):
            return []
        if self.loose:
            text = re.sub(r"\s+", " ", text)
        edges = [e for m in LINK.finditer(text) for e in m.span()]
        n, out = len(text), []
        bounds = [0, *edges, n]
        for last, (size, held, marked, order) in self.automaton.iter(lowered(text)):
            start, stop = last + 1 - size, last + 1
            if held is not None:
                k = bisect_right(edges, start)
                if k % 2 == 0:
                    lo, hi = bounds[k], bounds[k + 1]
                    if stop <= hi and (start == lo or not _word(text[start - 1])) and (stop == hi or not _word(text[stop])):
                        out.append(("held", start, stop, order, held))
            if marked and start and text[start - 1] == "*" and (start == 1 or text[start - 2].isspace() or text[start - 2] == "("):
                if stop == n or text[stop].isspace() or text[stop] in ENDS:
                    out.append(("marked", start, stop, -size, text[start:stop].strip()))
        return out


def _word(sign: str) -> bool:
    return sign.isascii() and sign.isalnum()


def settled(spans: Iterable[Span]) -> set[str]:
    """The terms of the places of one text that stand when it is read from left to right."""
    found, free = set(), {"held": 0, "marked": 0}
    for kind, start, stop, _, term in sorted(spans, key=lambda s: s[:2] + s[3:]):
        # a mark needs the sign before its asterisk too, unless it opens the text
        if (start if kind == "held" else max(start - 2, 0)) >= free[kind]:
            found.add(term)
            free[kind] = stop
    return found


def _parts(forms: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The forms in parts of about `most_bytes`."""
    size = forms.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-size // most_bytes))
    return [forms.where(F.pmod(F.xxhash64("form"), F.lit(n)) == i) if n > 1 else forms for i in range(n)]


def _shared(part: DataFrame):
    """A part's forms, on every machine that asks for them."""
    table = part.select("form", "held", "marked", "order").toArrow()
    return part.sparkSession.sparkContext.broadcast(table)


def _trie(table: pa.Table, loose: bool) -> Trie:
    return Trie(zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True), loose)


def tagged(texts: DataFrame, terms: DataFrame, *, loose: bool = False, marks: bool = True, most_bytes: int = FORMS_BYTES) -> DataFrame:
    """(id, terms), a row a text of (id, text): the sorted terms (term) that it holds and, with `marks`, marks.  With `loose` a blank
    of a term stands for any number of blanks and line ends."""
    rows, key = texts.select("id", "text"), texts.schema["id"].dataType.simpleString()
    forms = saved(forms_of(terms))
    if marks and forms.isEmpty():
        return rows.select("id", F.array_sort(fallback_markers(F.coalesce("text", F.lit("")))).alias("terms"))
    parts = _parts(forms, most_bytes)
    if len(parts) == 1:
        return rows.mapInArrow(_settling(_shared(parts[0]), loose, marks), f"id {key}, terms array<string>")
    rows = rows.withColumn("places", F.array().cast(f"array<{PLACE}>"))
    for part in parts:
        # one trie at a time in a task
        shared = _shared(part)
        rows = saved(rows.mapInPandas(_adding(shared, loose, marks), f"id {key}, text string, places array<{PLACE}>"))
        shared.destroy()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["id"]].assign(terms=[sorted(settled(tuple(p[k] for k in NAMES) for p in places)) for places in batch["places"]])

    return rows.select("id", "places").mapInPandas(run, f"id {key}, terms array<string>")


def _settling(shared, loose: bool, marks: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value, loose)
        for batch in batches:
            found = [sorted(settled(s for s in trie.spans(t or "") if marks or s[0] == "held")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "terms"])

    return run


def _adding(shared, loose: bool, marks: bool):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(shared.value, loose)
        for batch in batches:
            found = [[dict(zip(NAMES, s, strict=True)) for s in trie.spans(t or "") if marks or s[0] == "held"] for t in batch["text"]]
            yield batch[["id", "text"]].assign(places=[[*old, *new] for old, new in zip(batch["places"], found, strict=True)])

    return run


def used(texts: DataFrame, terms: DataFrame, **options) -> DataFrame:
    """(id, term): the terms of :func:`tagged`, each once a text's id."""
    return tagged(texts, terms, **options).select("id", F.explode("terms").alias("term")).distinct()
