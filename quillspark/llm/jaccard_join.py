"""Exact n-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct ``gram``-word shingles (A-Z lower-cased; a
shorter text is one shingle, a text without words none).  Two documents link when
``100 * |x & y| >= percent * |x | y|``.

1. Equal texts form classes; all later work is on classes.  A class is named by a
   64-bit hash; names that unlike texts (by their MD5 sums) share are given up for others.
2. Shingles have one fixed order: by hash, but those frequent in a bounded sample come
   last (any order gives the same links; this one keeps common lines out of the way).
   Linked sets share a shingle among their first ``n - ceil(t n) + 1``; the least class
   with such a shared shingle is its *hub*, and every class that shares it joins the
   hub's group.  So every pair that can link meets in a group, and near copies, which
   share dozens of shingles, meet in a few groups only.
3. A group of more than ``block`` members is cut into tiles by size band (a factor of
   1/t) and, where a band is still larger, by blocks: each pair of neighbouring bands and
   blocks is one tile, so a group of any size is spread over many tasks and no pair is
   emitted.
4. In a tile every class has a parity bitmap of one or two bits a shingle.  The number
   of bits in which two bitmaps differ is at most the sets' symmetric difference, so a
   bit count bounds the overlap from above.  A first pass carries only the bitmaps and
   leaves the classes with a possible partner; their texts are then joined, and pairs
   that pass and aren't connected yet are intersected: first the sorted arrays of
   shingle hashes, then, where those link, the shingles themselves, word by word.
5. The tiles' links (a forest each) become connected components; classes are joined
   back to documents.

Defined cases: null and empty texts have n_shingles 0 and stand alone; equal rows and
ties go to the same component; a null id takes part but never names a component with
another id; very long texts are shingled whole; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, small_batches
from quillspark.llm.components import components
from quillspark.llm.textkit import Words, gram_hashes, mix64, text_buffer, word_slices

GRAM = 5
PERCENT = 80
BLOCK = 1024
SAMPLE = 4000


def shingle_sets(words, gram: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    hashes = words.hashes(lower=True)
    grams = gram_hashes(hashes, gram)
    out = []
    for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if y - x >= gram:
            out.append(np.unique(grams[x : y - gram + 1]))
        elif y > x:
            whole = np.uint64(y - x)
            for h in hashes[x:y]:
                whole = mix64((whole ^ h).reshape(1))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared_shingles(x: bytes, y: bytes, gram: int) -> tuple[int, int]:
    """How many distinct shingles two texts share, and have together; by their words, not by hashes.

    A text of fewer words than `gram` is one shingle, which only an equal text shares."""
    offsets = np.array([0, len(x), len(x) + len(y)])
    words = Words(np.frombuffer(x + y, np.uint8), offsets)
    code = words.codes(lower=True)
    a, b = np.diff(words.first).tolist()
    if min(a, b) < gram:
        return (1, 1) if a == b and np.array_equal(code[:a], code[a:]) else (0, 2)
    ids = code[: len(code) - gram + 1]
    for k in range(1, gram):
        ids = np.unique(ids * (int(code.max()) + 1) + code[k : len(code) - gram + 1 + k], return_inverse=True)[1]
    left, right = np.unique(ids[: a - gram + 1]), np.unique(ids[a:])
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared, len(left) + len(right) - shared


def _class_name(text: Column, attempt: int) -> Column:
    return F.xxhash64(text) if attempt == 0 else F.xxhash64(F.md5(text), F.lit(attempt))


def _classes(docs: DataFrame, gram: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, text), and a table of (doc_id, cls, n, bits); one class a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", text.alias("text"))
    named, attempt = plain.select("doc_id", _class_name(F.col("text"), 0).alias("cls"), "text"), 0
    while True:
        sizes = saved(_sizes(named, gram), "shingle-counts")
        sums = sizes.groupBy("cls").agg(F.min("sum").alias("a"), F.max("sum").alias("b")).where("a <> b").select("cls")
        shared = saved(sums, "shared-names")
        if not shared.limit(1).count():
            return named, sizes.drop("sum")
        attempt += 1
        kept = F.when(F.col("other").isNull(), F.col("cls")).otherwise(_class_name(F.col("text"), attempt))
        named = named.join(shared.withColumnRenamed("cls", "other"), F.col("cls") == F.col("other"), "left").select("doc_id", kept.alias("cls"), "text")


def _sizes(docs: DataFrame, gram: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [md5(t.encode(), usedforsecurity=False).digest() for t in batch.column(2).to_pylist()]
            for a, b, words in word_slices(batch.column(2)):
                sets = shingle_sets(words, gram)
                n = np.array([len(s) for s in sets], np.int64)
                bits = [bitmap(s, int(w)).tobytes() for s, w in zip(sets, _width(n), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(bits, pa.binary()), pa.array(sums[a:b], pa.binary())], names=["doc_id", "cls", "n", "bits", "sum"])

    return docs.mapInArrow(run, f"doc_id {kind}, cls bigint, n bigint, bits binary, sum binary")


def _unseen(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their class in this task (as far as a bounded memory goes:
    a class that comes up again only repeats rows that are made distinct later)."""
    if len(seen) > 1_000_000:
        seen.clear()
    fresh = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            fresh[i] = True
    return fresh


def _common(docs: DataFrame, gram: int, n_docs: int, sample: int) -> np.ndarray:
    """Shingles of one in 200 documents or more, by a sample of about `sample` documents.

    Only the order of shingles depends on it, never a link; at most 2**18 come back."""
    some = docs.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, n_docs // sample))) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_slices(batch.column(1)):
                sets = shingle_sets(words, gram)
                got, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    found = some.select("cls", "text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(20, min(n_docs, sample) // 200))
    got = found.orderBy(F.desc("n"), "token").limit(1 << 18).select("token").toArrow()["token"].to_numpy()
    return np.sort(got.view(np.uint64))


def _members(docs: DataFrame, common: np.ndarray, gram: int, percent: int) -> DataFrame:
    """(hub, cls): for each shingle that leads several classes, its least class and all others."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = shipped.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = _unseen(keys, seen)
            batch, keys = batch.filter(pa.array(fresh)), keys[fresh]
            for a, b, words in word_slices(batch.column(1)):
                tokens, size = [], []
                for s in shingle_sets(words, gram):
                    lead = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                    if len(last) and len(s):
                        i = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        hot = last[i] == s
                        s = np.concatenate([s[~hot], s[hot]])
                    tokens.append(s[:lead])
                    size.append(lead)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(keys[a:b], size))], names=["token", "cls"])

    rows = docs.select("cls", "text").mapInArrow(run, "token bigint, cls bigint")
    rows = saved(rows, "leading-shingles")
    # partial minima and a join that can be split, as a shingle may lead a third of all classes
    hubs = saved(rows.groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where("hub <> last").select("token", "hub"), "shingle-hubs")
    return rows.join(hubs, "token").where("hub <> cls").select("hub", "cls").distinct()


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of the signature of a set of each size: a power of two of about its size."""
    return np.minimum(np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(int)), 32768)


def _tiles(members: DataFrame, block: int, percent: int) -> DataFrame:
    """(hub, tile, side, cls) for members (hub, cls, n); see :func:`_allowed` for the sides.

    A group of at most `block` members is one tile.  A larger one has a tile a size band,
    with the members of the band (side 0) and of the next (side 2).  Where a band is larger
    than a block, its members fall into k blocks, and every two blocks of neighbouring
    bands (sides 1 and 2) or of one band are a tile, so a member has about 3k copies."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent)) + 1e-9).cast("int")
    banded = members.withColumn("b", band)
    counts = banded.groupBy("hub", "b").agg(F.count("*").alias("m")).groupBy("hub").agg(F.sum("m").alias("m"), F.ceil(F.max("m") / F.lit(block)).cast("int").alias("k"))
    # a table, so that both sides of the join are plain exchanges, which can be split where a hub is hot
    placed = banded.join(saved(counts, "hub-sizes"), "hub")
    own, upper = F.struct(F.col("b").cast("string").alias("tile"), F.lit(0).alias("side")), F.struct((F.col("b") - 1).cast("string").alias("tile"), F.lit(2).alias("side"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    b, i = F.col("b"), F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")

    def spot(b1: Column, i1: Column, b2: Column, i2: Column) -> Column:
        return F.concat_ws(".", b1, i1, b2, i2)

    within = F.transform(every, lambda j: F.struct(spot(b, F.least(i, j), b, F.greatest(i, j)).alias("tile"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("side")))
    above = F.transform(every, lambda j: F.struct(spot(b, i, b + 1, j).alias("tile"), F.lit(1).alias("side")))
    under = F.transform(every, lambda j: F.struct(spot(b - 1, j, b, i).alias("tile"), F.lit(2).alias("side")))
    whole = F.array(F.struct(F.lit("").alias("tile"), F.lit(0).alias("side")))
    places = F.when(F.col("m") <= block, whole).when(F.col("k") == 1, F.array(own, upper)).otherwise(F.concat(within, above, under))
    return placed.select("hub", "cls", F.explode(places).alias("t")).select("hub", "t.tile", "t.side", "cls")


def _allowed(side: int, others: np.ndarray) -> np.ndarray:
    """Which sides are compared: 0 with 0 and 2, 1 with 2 only, 2 never with 2."""
    if side == 2:
        return others != 2
    return (others == 2) | ((others == 0) & (side == 0))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmap: bit i is set when an odd number of shingles falls on it."""
    bits = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _fold(signature: np.ndarray) -> np.ndarray:
    half = len(signature) // 2
    return signature[:half] ^ signature[half:]


def passing(size: np.ndarray, signatures: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): each member of a tile with the larger members that its bitmap allows."""
    order = np.argsort(size, kind="stable")
    width = np.array([64 * len(s) for s in signatures])
    for w in np.unique(width).tolist():
        own = order[(width[order] == w) | (width[order] == 2 * w)]
        rows = np.stack([signatures[i] if width[i] == w else _fold(signatures[i]) for i in own])
        n = size[own]
        for at in range(len(own)):
            i = int(own[at])
            if width[i] != w:
                break
            stop = int(np.searchsorted(n, n[at] * 100 // percent, side="right"))
            if stop <= at + 1:
                continue
            others = own[at + 1 : stop]
            apart = np.bitwise_count(rows[at] ^ rows[at + 1 : stop]).sum(1, dtype=np.int64)
            total = n[at] + n[at + 1 : stop]
            # overlap <= (total - apart) / 2 and overlap >= t * (total - overlap)
            good = (100 + percent) * (total - apart) >= 2 * percent * total
            good &= _allowed(int(side[i]), side[others])
            if good.any():
                yield i, others[good]


def tile_links(sets: list[np.ndarray], side: np.ndarray, percent: int, confirm=lambda i, j: True) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile; `confirm` has the last word on a pair."""
    size = np.array([len(s) for s in sets])
    signatures = [bitmap(s, 2 * int(w)) for s, w in zip(sets, _width(size), strict=True)]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, others in passing(size, signatures, side, percent):
        for j in others.tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            x, y = sets[i], sets[j]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared) and confirm(i, j):
                root[a] = b
                links.append((i, j))
    return links


def _by_tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles of rows sorted by (hub, tile), which are the first two columns; one row a class."""
    held: list[pa.RecordBatch] = []
    name = None

    def whole() -> pa.Table:
        found = pa.Table.from_batches(held).combine_chunks()
        _, first = np.unique(found["cls"].to_numpy(), return_index=True)
        return found.take(pa.array(first))

    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False)
        t = np.array(batch.column(1).to_pylist(), object)
        cut = np.flatnonzero((h[1:] != h[:-1]) | (t[1:] != t[:-1])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
            if a == b:
                continue
            if name is not None and name != (h[a], t[a]):
                yield whole()
                held = []
            name = (h[a], t[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _survivors(tiled: DataFrame, percent: int) -> DataFrame:
    """The rows of each tile that the bitmaps allow a partner."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _by_tile(batches):
            if len(tile) < 2:
                continue
            signatures = [np.frombuffer(b, np.uint64) for b in tile["bits"].to_pylist()]
            keep = np.zeros(len(tile), bool)
            for i, others in passing(tile["n"].to_numpy(), signatures, tile["side"].to_numpy(), percent):
                keep[i] = True
                keep[others] = True
            if keep.any():
                yield from tile.filter(pa.array(keep)).drop_columns(["n", "bits"]).to_batches()

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in tiled.schema if f.name not in ("n", "bits")]
    return tiled.mapInArrow(run, ", ".join(kept))


def _links(tiled: DataFrame, gram: int, percent: int) -> DataFrame:
    """(a, b) of linked classes; `tiled` is (hub, tile, side, cls, text), sorted by tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _by_tile(batches):
            keys = tile["cls"].to_numpy()
            sets = [s for _, _, words in word_slices(tile["text"]) for s in shingle_sets(words, gram)]
            data, at = text_buffer(tile["text"])

            def linked(i: int, j: int, data=data, at=at) -> bool:
                shared, together = shared_shingles(data[at[i] : at[i + 1]].tobytes(), data[at[j] : at[j + 1]].tobytes(), gram)
                return 100 * shared >= percent * together

            pairs = np.array(tile_links(sets, tile["side"].to_numpy(), percent, linked), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[pairs[:, 0]]), pa.array(keys[pairs[:, 1]])], names=["a", "b"])

    return tiled.mapInArrow(run, "a bigint, b bigint")


def link_documents(docs: DataFrame, *, gram: int = GRAM, percent: int = PERCENT, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs, sizes = _classes(docs, gram)
    common = _common(docs, gram, sizes.count(), sample)
    reps = sizes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    pairs = saved(_members(docs, common, gram, percent), "hubs")
    members = pairs.union(pairs.select("hub", F.col("hub").alias("cls")).distinct())
    tiles = _tiles(members.join(reps.select("cls", "n"), "cls"), block, percent)
    # the bitmaps join last, and are shuffled once
    tiles = tiles.join(reps, "cls").select("hub", "tile", "side", "cls", "rep", "n", "bits")
    tiles = saved(_survivors(tiles.repartition("hub", "tile").sortWithinPartitions("hub", "tile"), percent), "tiles").alias("t")
    texts = docs.alias("d")
    # merged at every size: a plan that broadcasts what happens to be small would not be the one that scales
    tiled = texts.join(tiles.hint("merge"), (F.col("t.cls") == F.col("d.cls")) & F.col("t.rep").eqNullSafe(F.col("d.doc_id"))).select("t.hub", "t.tile", "t.side", "t.cls", "d.text")
    links = _links(tiled.repartition("hub", "tile").sortWithinPartitions("hub", "tile"), gram, percent)
    roots = components(links)
    placed = sizes.join(roots, sizes.cls == roots.node, "left").select("doc_id", "n", F.coalesce("root", "cls").alias("root"))
    placed = saved(placed, "placed")
    names = saved(placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "component-names")
    named = placed.where("n > 0").join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return named.union(placed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


