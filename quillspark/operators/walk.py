"""Steps of a walk over a graph, by blocks of nodes.

Nodes and terms have numbers, and a block is a run of numbers.  The links of a block's nodes are laid out
once, in chunks of arrays that are sorted by where they lead; the masses of a block are one array.  A step
multiplies and adds up inside tasks, and Spark shuffles one sum a block and node that it leads to.  What arrives
at a term goes to the blocks of its users, to each block once, and from there to the users.

Steps are narrow over blocks, so several of them are one job; every few the masses are written to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import tables
from quillspark.operators.ordering import ranked
from quillspark.operators.tables import saved, shared_dir

#: Nodes of a block: about 48 blocks, within these bounds; links of a chunk; columns that walk together.
SMALLEST, LARGEST, BLOCKS = 1 << 16, 1 << 20, 48
CHUNK, COLUMNS = 2_000_000, 8
_LINK, _TO_TERM, _USE = 0, 1, 2


def _same(part: int) -> int:
    return part


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, src, to, p), in the order of part, kind and to, as chunks of arrays."""
    held, size, key = [], 0, -1

    def chunk() -> pa.RecordBatch:
        src, to, p = (np.concatenate(c) for c in zip(*held, strict=True))
        ends, first = np.unique(to, return_index=True)
        arrays = [pa.array([v.tobytes()], pa.binary()) for v in (src.astype(np.int32), p, first, ends)]
        return pa.RecordBatch.from_arrays([pa.array([key // 4], pa.int32()), pa.array([key % 4], pa.int32()), *arrays], names=["part", "kind", "src", "p", "first", "ends"])

    for batch in batches:
        part, kind, src, to, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        code = part.astype(np.int64) * 4 + kind
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1), len(code)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and (code[lo] != key or size >= CHUNK):
                yield chunk()
                held, size = [], 0
            key = int(code[lo])
            held.append((src[lo:hi], to[lo:hi], p[lo:hi]))
            size += hi - lo
    if held:
        yield chunk()


def _arrays(row) -> tuple[int, tuple]:
    return row[0], (row[1], np.frombuffer(row[2], np.int32), np.frombuffer(row[3], np.float64), np.frombuffer(row[4], np.int64), np.frombuffer(row[5], np.int64))


def _drained(rows: Iterator) -> None:
    """Reads what a worker has no use for: one that leaves rows unread isn't used again."""
    for _ in rows:
        pass


def _gather(keep: float, rest: float):
    """Masses of a block from rows that hold them as they are, or from what arrived at its nodes, at terms, and its uses of terms; and the
    first row after those."""

    def gathered(size: int, rows: Iterator) -> tuple[np.ndarray, tuple | None]:
        out, terms, values, link, known = None, [], [], None, None
        for v in rows:
            if v[0] == "x":
                known = v[1]
            elif v[0] in ("got", "term"):
                out = np.zeros((size, v[2].shape[1])) if out is None else out
                if v[0] == "got":
                    out[v[1]] += v[2]
                else:
                    terms.append(v[1])
                    values.append(v[2])
            elif v[0] != _USE:
                link = v
                break
            elif terms:
                if len(terms) > 1 or not np.all(terms[0][1:] > terms[0][:-1]):
                    # parts of one term part's values may have been asked for by several chunks
                    every, first = np.unique(np.concatenate(terms), return_index=True)
                    terms, values = [every], [np.concatenate(values)[first]]
                if not len(terms[0]):
                    continue
                _, src, p, first, ends = v
                spot = np.minimum(np.searchsorted(terms[0], ends), len(terms[0]) - 1)
                each = values[0][spot] * (terms[0][spot] == ends)[:, None]
                count = np.diff(np.r_[first, len(src)])
                for c in range(each.shape[1]):
                    out[:, c] += np.bincount(src, np.repeat(each[:, c], count) * p, size)
        if known is not None:
            return known, link
        return np.full((size, 1), rest) if out is None else rest + keep * out, link

    return gathered


class Held:
    """Masses as rows of what they come from, and how a task makes them of it."""

    def __init__(self, rows: RDD, gathered=_gather(1.0, 0.0)) -> None:  # noqa: B008  holds no state
        self.rows, self.gathered = rows, gathered


class Walk:
    """A walk over ``names`` (id, g) by ``links`` (a, b, p) from node to node, ``to_terms`` (a, t, p) from node to term and
    ``uses`` (b, t, w) that hand on to all users what arrives at a term."""

    def __init__(self, names: DataFrame, links: DataFrame, to_terms: DataFrame, uses: DataFrame, block: int | None = None) -> None:
        self.spark, self.names = names.sparkSession, names
        self.n = names.count()
        self.block = block or min(max(-(-self.n // BLOCKS), SMALLEST), LARGEST)
        words = uses.agg(F.max("t")).first()[0]
        self.blocks = max(1, -(-self.n // self.block))
        self.parts = self.blocks + (0 if words is None else words // self.block + 1)
        self.paths: list[str] = []

        def cells(df: DataFrame, at: str, to: str, x: str, kind: int) -> DataFrame:
            ahead = 0 if kind == _LINK else self.blocks * self.block
            return df.select(F.expr(f"int({at} div {self.block})").alias("part"), F.lit(kind).alias("kind"), F.expr(f"int({at} % {self.block})").alias("src"), (F.col(to).cast("long") + ahead).alias("to"), F.col(x).alias("p"))

        every = cells(links, "a", "b", "p", _LINK).union(cells(to_terms, "a", "t", "p", _TO_TERM)).union(cells(uses, "b", "t", "w", _USE))
        packed = every.repartition(self.blocks, "part").sortWithinPartitions("part", "kind", "to").mapInArrow(_pack, "part int, kind int, src binary, p binary, first binary, ends binary")
        laid = packed.rdd.map(_arrays).partitionBy(self.parts, _same)
        self.links = laid.filter(lambda r: r[1][0] != _USE).persist(StorageLevel.MEMORY_AND_DISK)
        self.uses = laid.filter(lambda r: r[1][0] == _USE).persist(StorageLevel.MEMORY_AND_DISK)
        block = self.block

        def asks(rows: Iterable) -> Iterator:
            for part, (_, _, _, _, ends) in rows:
                at = ends // block
                for term_part in np.unique(at):
                    yield int(term_part), ("asked", part, ends[at == term_part] % block)

        self.asked = self.uses.mapPartitions(asks).partitionBy(self.parts, _same).persist(StorageLevel.MEMORY_AND_DISK)

    def _each(self, rows: RDD, f) -> RDD:
        """What `f` makes of each block's size and rows: its masses."""
        blocks, block, n = self.blocks, self.block, self.n

        def run(part: int, own: Iterator) -> Iterator:
            if part < blocks:
                yield part, ("x", f(max(0, min(block, n - part * block)), (v for _, v in own)))
            else:
                _drained(own)

        return rows.mapPartitionsWithIndex(run, preservesPartitioning=True)

    def flat(self, x: float) -> RDD:
        """The same mass for every node."""
        none = self.spark.sparkContext.emptyRDD().partitionBy(self.parts, _same)
        return self._each(none, lambda size, _: np.full((size, 1), x))

    def masses(self, rows: DataFrame, columns: int) -> RDD:
        """Masses of rows (g, c, x): of the node g in the column c."""
        block = self.block
        found = rows.select("g", "c", "x").rdd.map(lambda r: (r[0] // block, (r[0] % block, r[1], r[2]))).partitionBy(self.parts, _same)

        def dense(size: int, own: Iterable) -> np.ndarray:
            out = np.zeros((size, columns))
            for at, c, x in own:
                out[at, c] += x
            return out

        return self._each(found, dense)

    def pushed(self, held: Held, keep: float = 1.0, rest: float = 0.0) -> Held:
        """`rest` and `keep` times what every node gets when all nodes pass their masses `held` on."""
        block, blocks, n, gathered = self.block, self.blocks, self.n, held.gathered

        def spread(part: int, rows: Iterator) -> Iterator:
            """Masses from what arrived, then over the links, which come after it."""
            own = (v for _, v in rows)
            if part >= blocks:
                _drained(own)
                return
            x, link = gathered(max(0, min(block, n - part * block)), own)
            while link is not None:
                _, src, p, first, ends = link
                got = np.add.reduceat(x[src] * p[:, None], first, axis=0)
                some = got.any(axis=1)
                got, to = got[some], ends[some]
                cuts = [0, *(np.flatnonzero(np.diff(to // block)) + 1), len(to)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo < hi:
                        yield int(to[lo] // block), ("got", (to[lo:hi] % block).astype(np.int32), got[lo:hi])
                link = next(own, None)

        def hand(part: int, rows: Iterator) -> Iterator:
            if part < blocks:
                _drained(rows)
                return
            at, values, asked = [], [], []
            for _, v in rows:
                if v[0] == "got":
                    at.append(v[1])
                    values.append(v[2])
                elif v[0] == "asked":
                    asked.append(v[1:])
            if not at or not asked:
                return
            sums = np.zeros((max(int(a.max()) for a in [*at, *(i for _, i in asked)]) + 1, values[0].shape[1]))
            for a, v in zip(at, values, strict=True):
                sums[a] += v
            for to, i in asked:
                some = sums[i].any(axis=1)
                yield to, ("term", i[some] + part * block, sums[i[some]])

        arrived = held.rows.union(self.links).mapPartitionsWithIndex(spread).partitionBy(self.parts, _same)
        handed = arrived.union(self.asked).mapPartitionsWithIndex(hand).partitionBy(self.parts, _same)
        return Held(arrived.union(handed).union(self.uses), _gather(keep, rest))

    def masses_of(self, held: Held) -> RDD:
        """(block, its masses)."""
        gathered = held.gathered
        return self._each(held.rows, lambda size, own: gathered(size, own)[0])

    def kept(self, masses: RDD) -> RDD:
        """`masses` written to the shared folder and read back."""
        path = f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}"
        tables._written.append((self.spark, path))
        self.paths.append(path)
        masses.saveAsPickleFile(path)
        return self.spark.sparkContext.pickleFile(path, self.parts).partitionBy(self.parts, _same)

    def forget(self, but: int = 0) -> None:
        """Deletes what :meth:`kept` wrote, but for the last few."""
        gone = [t for t in tables._written if t[1] in self.paths[: len(self.paths) - but]]
        tables._remove(gone)
        tables._written[:] = [t for t in tables._written if t not in gone]
        self.paths = self.paths[len(self.paths) - but :]

    def rows(self, masses: RDD, zeros: bool = True) -> DataFrame:
        """(g, c, x), with or without zeros."""
        block = self.block

        def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, columns, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    x = np.frombuffer(data).reshape(-1, columns)
                    for lo in range(0, len(x), 1 << 16):
                        at, c = np.nonzero(x[lo : lo + (1 << 16)] != 0) if not zeros else (a.ravel() for a in np.indices(x[lo : lo + (1 << 16)].shape))
                        yield pa.RecordBatch.from_arrays([pa.array(at + lo + part * block), pa.array(c.astype(np.int32)), pa.array(x[at + lo, c])], names=["g", "c", "x"])

        plain = masses.map(lambda r: (r[0], r[1][1].shape[1], r[1][1].tobytes()))
        return self.spark.createDataFrame(plain, "part int, columns int, x binary").mapInArrow(unpack, "g long, c int, x double")

    def step(self, held: DataFrame) -> DataFrame:
        """(id, x): what each node gets when every node passes its x of `held` (id, x) on."""
        x = self.masses(held.join(self.names, "id").select("g", F.lit(0).alias("c"), "x"), 1)
        return self.rows(self.masses_of(self.pushed(Held(x))), zeros=False).join(self.names, "g").select("id", "x")

    def close(self) -> None:
        """Only when no plan reads the last steps."""
        self.forget()
        self.asked.unpersist()
        self.links.unpersist()
        self.uses.unpersist()

    def settled(self, gamma: float, rounds: int, tolerance: float, every: int = 10) -> DataFrame:
        """(id, x) as a table: x' = (1 - gamma) / n + gamma * x P from the uniform start; `rounds` rounds, or fewer if
        one (each `every`-th is looked at) changes less than `tolerance` altogether."""
        n = max(self.n, 1)
        x = Held(self.flat(1.0 / n))
        for k in range(rounds):
            last, x = x, self.pushed(x, gamma, (1 - gamma) / n)
            if (k + 1) % every == 0 and k + 1 < rounds:
                x = Held(self.kept(self.masses_of(x)))
                moved = self.masses_of(last).union(x.rows).mapPartitions(lambda rows: [_moved(v for _, v in rows)]).sum()
                self.forget(but=1)
                if k and moved < tolerance:
                    break
        out = saved(self.rows(self.masses_of(x)).join(self.names, "g").select("id", "x"))
        self.close()
        return out

    def diffused(self, seeds: DataFrame, gamma: float, rounds: int, every: int = 3) -> DataFrame:
        """(seed, id, mass) as a table: `rounds` steps from the masses of `seeds` (seed, id, w), a few seeds at a time."""
        known = saved(seeds.join(self.names, "id").select("seed", "g", "w"))
        who = saved(ranked(known.select("seed").distinct(), ["seed"], "s").select("seed", "s"))
        count, out = who.count(), None
        for first in range(0, max(count, 1), COLUMNS):
            some = who.where((F.col("s") >= first) & (F.col("s") < first + COLUMNS)).select("seed", (F.col("s") - first).cast("int").alias("c"))
            x = Held(self.masses(known.join(some, "seed").select("g", "c", F.col("w").alias("x")), max(1, min(COLUMNS, count - first))))
            steps, mass = [(x, 1 - gamma)], None
            for k in range(rounds):
                x = self.pushed(x, gamma)
                steps.append((x, 1.0 if k + 1 == rounds else 1 - gamma))
                if (k + 1) % every == 0 or k + 1 == rounds:
                    x = Held(self.kept(self.masses_of(x)))
                    steps[-1] = (x, steps[-1][1])
                    mass = self.kept(self._shared(steps, mass))
                    steps = []
                    self.forget(but=2)
            mass = self._shared(steps, None) if mass is None else mass
            part = saved(self.rows(mass, zeros=False).withColumnRenamed("x", "mass").join(self.names, "g").join(F.broadcast(some), "c").select("seed", "id", "mass"))
            out = part if out is None else out.union(part)
        self.close()
        return out


    def _shared(self, steps: list[tuple[Held, float]], mass: RDD | None) -> RDD:
        """`mass` and the share of each step."""
        for held, share in steps:
            own = self.masses_of(held).mapValues(lambda v, share=share: ("x", share * v[1]))
            mass = own if mass is None else mass.union(own)
        return self._each(mass, _added)


def _added(size: int, rows: Iterable) -> np.ndarray:
    """The sum of a block's masses; of a step that nothing arrived in, one column stands for all."""
    out = 0.0
    for v in rows:
        out = out + v[1]
    return out


def _moved(rows: Iterable) -> float:
    found = [v[1] for v in rows]
    return float(np.abs(found[1] - found[0]).sum()) if len(found) == 2 else 0.0
