"""Forward push with a queue a seed: personalised masses of many seeds.

A seed's residual lies in a queue, first in, first out: a node whose turn it is keeps ``1 - gamma``
of its residual and passes the rest on, except for shares below ``eps``; a neighbour joins the queue
when its residual comes to ``eps``.  Neighbours are served in the order of their names.  What a neighbour
gets is its *whole* share: edges and all terms in common together.

Every seed is pushed inside a task and only its largest masses leave it, so no (seed, node) table
exists.  The graph is compressed rows: edges with their joint shares, the terms of a node, the
users of a term.  A place in the queue is a number (step, node), and only nodes that can pass something on are taken
from it; any other one keeps its part as soon as somebody asks and its place has gone by, which is the same.

A term's users are bits, and a node's neighbours through terms are counted by words of 64: only those that get
``eps`` at all are named.  Where a seed's own share would reach all users of its terms and none of them can
pass anything on, they are not visited: one that an edge reaches later is looked up in the bits, and at the end the largest
masses are found among users of many of the terms, as long as no user of fewer can come up to them.

Where the rows take at most ``limit`` bytes they are broadcast.  Beyond that, seeds go in blocks and
ask for rows: a block pushes with the rows it has, names the nodes whose rows it lacks, and is pushed
again with those, until none is lacking.  It is the same code and the same order, so the masses are the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ordering import ranked
from quillspark.operators.tables import saved

EPS, TOP = 1e-6, 200
LIMIT = 256 << 20
BLOCK = 64
#: Up to so many neighbours numbers are quicker than arrays.
_FEW = 16


def _grouped(key: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0..n-1 begins in the sorted `key` (n+1)."""
    return np.searchsorted(key, np.arange(n + 1))


class Star:
    """The users of a node's terms as bits, a set a term, and the share of a user of each."""

    def __init__(self, sets: list[np.ndarray], q: np.ndarray) -> None:
        self.sets, self.q = sets, q
        self.sums = np.concatenate([[0.0], np.cumsum(np.sort(q)[::-1])])
        self.planes: list[np.ndarray] | None = None

    def most(self, count: int) -> float:
        """The largest share through so many terms."""
        return float(self.sums[count])

    def count_for(self, least: float) -> int:
        """So many terms in common a share of `least` takes; one at least."""
        return max(1, int(np.searchsorted(self.sums, least * (1 - 1e-9))))

    def having(self, count: int) -> np.ndarray:
        """The users of at least `count` of the terms, ascending."""
        if count > len(self.sets):
            return np.zeros(0, np.int64)
        if count == 1:
            words = np.bitwise_or.reduce(self.sets)
        else:
            if self.planes is None:
                # counts in binary, a set a digit
                planes: list[np.ndarray] = []
                for carry in self.sets:
                    for i, plane in enumerate(planes):
                        planes[i], carry = plane ^ carry, plane & carry
                    if len(planes) < (len(self.sets)).bit_length():
                        planes.append(carry)
                self.planes = planes
            words, equal = np.zeros_like(self.sets[0]), ~np.zeros_like(self.sets[0])
            for i in range(len(self.planes) - 1, -1, -1):
                if count >> i & 1:
                    equal = equal & self.planes[i]
                else:
                    words |= equal & self.planes[i]
                    equal = equal & ~self.planes[i]
            words |= equal
        at = np.flatnonzero(words)
        i = np.flatnonzero(np.unpackbits(words[at].view(np.uint8), bitorder="little"))
        return at[i >> 6] * 64 + (i & 63)

    def shares(self, nodes: np.ndarray) -> np.ndarray:
        """What each node gets through the terms, added up in their order."""
        out, word, bit = np.zeros(len(nodes)), nodes >> 6, (nodes & 63).astype(np.uint64)
        for own, q in zip(self.sets, self.q, strict=True):
            out += q * (own[word] >> bit & np.uint64(1))
        return out


class Rows:
    """A graph, or the part of one that is at hand, in arrays.

    names: numbers of the nodes, ascending.  Edges (a, b, share), terms (a, t, share of a single
    other user) and users (t, b) by places in `names`; `most` is the largest share that a node's row holds and
    `known` whether its row is here."""

    def __init__(self, names: np.ndarray, edges: tuple[np.ndarray, ...], terms: tuple[np.ndarray, ...], users: tuple[np.ndarray, ...], most: np.ndarray, known: np.ndarray) -> None:
        n = len(names)
        self.names, self.most, self.known = names, most, known
        order = np.lexsort((edges[1], edges[0]))
        self.node, self.share = edges[1][order].astype(np.int32), edges[2][order]
        self.first = _grouped(edges[0][order], n)
        order = np.lexsort((terms[1], terms[0]))
        self.term, self.q = terms[1][order].astype(np.int32), terms[2][order]
        self.term_first = _grouped(terms[0][order], n)
        order = np.argsort(users[0], kind="stable")
        self.users = users[1][order].astype(np.int32)
        self.user_first = _grouped(users[0][order], int(users[0].max(initial=-1)) + 1)
        through = np.zeros(n)
        np.add.at(through, terms[0], terms[2])
        self.through = through
        self.term_most = np.zeros(len(self.user_first) - 1)
        np.maximum.at(self.term_most, users[0], most[users[1]])
        self.residual, self.mass, self.summed = np.zeros(n), np.zeros(n), np.zeros(n)
        self.turn, self.seen, self.flags = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(-(-n // 64) * 64, bool)
        self.sets: dict[int, np.ndarray] = {}
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bits(self, t: int) -> np.ndarray:
        """The users of a term as bits; kept where the list of them is no shorter."""
        found = self.sets.get(t)
        if found is None:
            own = self.users[self.user_first[t] : self.user_first[t + 1]]
            self.flags[own] = True
            found = np.packbits(self.flags, bitorder="little").view(np.uint64)
            self.flags[own] = False
            if 32 * len(own) >= len(self.names):
                self.sets[t] = found
        return found

    def star(self, u: int) -> Star | None:
        """The terms of a node as bits; None where lists of their users are short."""
        a, b = self.term_first[u], self.term_first[u + 1]
        t = self.term[a:b]
        if 64 * (self.user_first[t + 1] - self.user_first[t]).sum() < len(self.names):
            return None
        return Star([self.bits(int(x)) for x in t], self.q[a:b])

    def row(self, u: int, star: Star | None, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of a node and their shares, edges and terms together; of a star's, those that get `least`."""
        a, b = self.first[u], self.first[u + 1]
        if star is not None:
            near = star.having(star.count_for(least))
            self.flags[self.node[a:b]] = True
            self.flags[u] = True
            near = near[~self.flags[near]]
            self.flags[self.node[a:b]] = False
            self.flags[u] = False
            shares = star.shares(near)
            near, shares = np.concatenate([near, self.node[a:b]]), np.concatenate([shares, self.share[a:b]])
            order = np.argsort(near, kind="stable")
            return near[order], shares[order]
        if u not in self.whole:
            parts = []
            for i in range(self.term_first[u], self.term_first[u + 1]):
                t = self.term[i]
                own = self.users[self.user_first[t] : self.user_first[t + 1]]
                self.summed[own] += self.q[i]  # a term names a user once
                parts.append(own)
            near = np.union1d(np.concatenate(parts), self.node[a:b])
            self.summed[u] = 0.0
            self.summed[self.node[a:b]] = self.share[a:b]
            shares = self.summed[near]
            self.summed[near] = 0.0
            keep = shares > 0
            if len(self.whole) >= 64:
                self.whole.clear()
            self.whole[u] = near[keep], shares[keep]
        return self.whole[u]

    def push(self, seeds: np.ndarray, weights: np.ndarray, gamma: float, eps: float, top: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """(nodes, masses) of the `top` largest masses, and the nodes whose rows were lacking."""
        n, acts = len(self.names), 0
        residual, mass, turn, most = self.residual, self.mass, self.turn, self.most
        residual[seeds] = weights
        turn[seeds] = np.arange(len(seeds))
        self.seen[seeds] = True
        able = (weights >= eps) & (gamma * weights * most[seeds] >= eps)
        heap = [(int(i), int(seeds[i])) for i in np.flatnonzero(able)]
        met, lacking, rest = [seeds], set(), None
        while heap:
            key, u = heapq.heappop(heap)
            value = float(residual[u])
            mass[u] += (1 - gamma) * value
            residual[u] = 0.0
            if not self.known[u]:
                lacking.add(u)
                continue
            acts += 1
            passed = gamma * value
            near, share = self.node[self.first[u] : self.first[u + 1]], self.share[self.first[u] : self.first[u + 1]]
            if self.term_first[u] < self.term_first[u + 1] and passed * self.through[u] >= eps:
                star = self.star(u)
                if star is not None and acts == 1 and len(seeds) == 1 and gamma * passed * self.through[u] * self.star_most(u) < eps:
                    rest = (star, passed, acts * n)
                    # an edge decides what its end gets, so no star reaches that again
                    ends = near[~self.seen[near]]
                    met.append(ends)
                    self.seen[ends] = True
                else:
                    near, share = self.row(u, star, eps / passed)
            got = passed * share
            enough = np.flatnonzero(got >= eps)
            near, got = near[enough], got[enough]
            fresh = near[~self.seen[near]]
            if len(fresh):
                self.seen[fresh] = True
                met.append(fresh)
                if rest is not None:
                    had = rest[1] * rest[0].shares(fresh)
                    had[had < eps] = 0.0
                    residual[fresh] = had
                    turn[fresh] = rest[2] + fresh
            if len(near) <= _FEW:
                for v, g in zip(near.tolist(), got.tolist(), strict=True):
                    before, reach = residual.item(v), most.item(v)
                    if before >= eps and turn.item(v) < key:
                        mass[v] += (1 - gamma) * before
                        before = 0.0
                    after = before + g
                    residual[v] = after
                    if before < eps <= after:
                        turn[v] = acts * n + v
                    if after >= eps and gamma * after * reach >= eps and (before < eps or gamma * before * reach < eps):
                        heapq.heappush(heap, (turn.item(v), v))
                continue
            before, reach = residual[near], most[near]
            over = (before >= eps) & (turn[near] < key)  # their turn came, and they had nothing to pass on
            mass[near[over]] += (1 - gamma) * before[over]
            before[over] = 0.0
            after = before + got
            residual[near] = after
            new = near[(before < eps) & (after >= eps)]
            turn[new] = acts * n + new
            for v in near[(after >= eps) & (gamma * after * reach >= eps) & ((before < eps) | (gamma * before * reach < eps))].tolist():
                heapq.heappush(heap, (turn.item(v), v))
        nodes = np.concatenate(met)
        left = residual[nodes]
        masses = mass[nodes] + np.where(left >= eps, (1 - gamma) * left, 0.0)
        kept = masses > 0
        found, masses = nodes[kept], masses[kept]
        if rest is not None:
            others, more = self._best(rest[0], rest[1], gamma, eps, top)
            found, masses = np.concatenate([found, others]), np.concatenate([masses, more])
        mass[nodes] = 0.0
        residual[nodes] = 0.0
        self.seen[nodes] = False
        best = np.lexsort((found, -np.round(masses, 12)))[:top]
        return found[best], masses[best], lacking

    def star_most(self, u: int) -> float:
        """The largest share that a row of a user of a node's terms holds."""
        return float(self.term_most[self.term[self.term_first[u] : self.term_first[u + 1]]].max())

    def _best(self, star: Star, passed: float, gamma: float, eps: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, masses): the `top` largest masses among those that a star alone reaches; users of many of its terms first, until no
        user of fewer can come up to them."""
        for count in range(len(star.q), 0, -1):
            near = star.having(count)
            near = near[~self.seen[near]]
            got = passed * star.shares(near)
            near, got = near[got >= eps], got[got >= eps]
            masses = (1 - gamma) * got
            digits = np.round(masses, 12)
            limit = passed * star.most(count - 1) * (1 + 1e-9)
            if count == 1 or limit < eps or np.count_nonzero(digits > (1 - gamma) * limit + 1e-12) >= top:
                break
        if len(near) > top:
            last = np.partition(digits, len(near) - top)[len(near) - top]
            kept = np.concatenate([np.flatnonzero(digits > last), np.flatnonzero(digits == last)[:top]])
            near, masses = near[kept], masses[kept]
        return near, masses


@dataclass
class Coded:
    """A graph by numbers: ``names`` (id, g) in the order of their names, ``pairs`` (a, b, w), ``used`` (a, t, w), ``whole`` (a, total)."""

    names: DataFrame
    pairs: DataFrame
    used: DataFrame
    whole: DataFrame

    @staticmethod
    def of(nodes: DataFrame, direct: DataFrame, uses: DataFrame, totals: DataFrame) -> Coded:
        """From nodes (id), direct edges (id, node, w), uses of terms (id, term, w) and weights of whole rows (id, total)."""
        names = saved(ranked(nodes.select("id").distinct(), ["id"], "g").select("id", "g"))
        words = saved(ranked(uses.select("term").distinct(), ["term"], "t").select("term", F.col("t").cast("int").alias("t")))

        def coded(df: DataFrame, column: str, into: str) -> DataFrame:
            return df.join(names.select(F.col("id").alias(column), F.col("g").alias(into)), column).drop(column)

        used = saved(coded(uses.join(words, "term"), "id", "a").select("a", "t", "w"))
        whole = saved(coded(totals, "id", "a"))
        pairs = saved(coded(coded(direct, "id", "a"), "node", "b").select("a", "b", "w"))
        return Coded(names, pairs, used, whole)


@dataclass
class PushGraph:
    """The rows of a graph as tables, with numbers for nodes in the order of their names.

    ``names`` (id, g), ``edges`` (a, b, share, most), ``terms`` (a, t, share), ``users`` (t, b, most); `most` is the
    largest share that the row of b holds, and ``tops`` (a, most) has it for every node."""

    names: DataFrame
    edges: DataFrame
    terms: DataFrame
    users: DataFrame
    tops: DataFrame

    @staticmethod
    def of(coded: Coded) -> PushGraph:
        names, pairs, used, whole = coded.names, coded.pairs, coded.used, coded.whole
        # what the two ends of an edge share in terms comes on top of its own weight
        common = pairs.select("a", "b").join(used, "a").join(used.select(F.col("a").alias("b"), "t"), ["b", "t"]).select("a", "b", "w")
        joint = pairs.union(common).groupBy("a", "b").agg(F.sum("w").alias("w")).join(whole, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share"))
        alone = names.select(F.col("g").alias("a")).join(whole, "a", "left_anti").select("a", F.col("a").alias("b"), F.lit(1.0).alias("share"))
        edges = saved(joint.union(alone))
        terms = saved(used.join(whole, "a").select("a", "t", (F.col("w") / F.col("total")).alias("share")))
        most = edges.groupBy("a").agg(F.max("share").alias("most")).union(terms.groupBy("a").agg(F.sum("share").alias("most")))
        tops = saved(most.groupBy("a").agg(F.max("most").alias("most")))
        other = tops.withColumnRenamed("a", "b")
        return PushGraph(names, saved(edges.join(other, "b").select("a", "b", "share", "most")), terms, saved(used.select("t", F.col("a").alias("b")).join(other, "b").select("t", "b", "most")), tops)

    def size(self) -> int:
        """Bytes of the rows in arrays, by the numbers of rows, and of the names."""
        n, text = self.names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()
        return 12 * self.edges.count() + 12 * self.terms.count() + 4 * self.users.count() + 64 * n + text

    def arrays(self) -> Rows:
        """The whole graph on the driver; only after its size was checked."""

        def taken(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
            got = df.select(*columns).toArrow()
            return tuple(got[c].to_numpy() for c in columns)

        at, most = taken(self.tops, "a", "most")
        n = self.names.count()
        largest = np.zeros(n)
        largest[at] = most
        return Rows(np.arange(n), taken(self.edges, "a", "b", "share"), taken(self.terms, "a", "t", "share"), taken(self.users, "t", "b"), largest, np.ones(n, bool))


def _numbered(seeds: DataFrame, graph: PushGraph) -> tuple[DataFrame, DataFrame]:
    """(s, a, w) by numbers, and (s, seed): a number for each seed's name."""
    known = seeds.join(graph.names, "id").select("seed", F.col("g").alias("a"), "w").where("w > 0")
    who = saved(ranked(known.select("seed").distinct(), ["seed"], "s").select("seed", "s"))
    return saved(known.join(who, "seed").groupBy("s", "a").agg(F.sum("w").alias("w"))), who


def _pushed_whole(seeds: DataFrame, graph: PushGraph, gamma: float, eps: float, top: int) -> DataFrame:
    """Ranked and named inside the tasks, so that only seeds are shuffled."""
    spark = seeds.sparkSession
    shipped = spark.sparkContext.broadcast((graph.arrays(), graph.names.orderBy("g").select("id").toArrow()["id"].combine_chunks()))
    known = seeds.join(graph.names, "id").where("w > 0").groupBy("seed", "g").agg(F.sum("w").alias("w"))
    groups = known.groupBy("seed").agg(F.collect_list(F.struct("g", "w")).alias("x"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    groups = groups.select(F.col("seed").cast("string").alias("seed"), F.col("x.g").alias("a"), F.col("x.w").alias("w")).repartition(parts, "seed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names = shipped.value
        for batch in batches:
            for seed, a, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                order = np.argsort(a)
                nodes, masses, _ = rows.push(np.array(a)[order], np.array(w)[order], gamma, eps, top)
                own = pa.StructArray.from_arrays([names.take(pa.array(nodes)), pa.array(masses)], names=["id", "mass"])
                near = pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([seed], pa.string()), near, pa.array([masses.sum()])], names=["seed", "near", "captured"])

    return groups.mapInArrow(run, "seed string, near array<struct<id:string,mass:double>>, captured double")


def _pushed_by_rows(seeds: DataFrame, graph: PushGraph, gamma: float, eps: float, top: int, block: int) -> DataFrame:
    """Blocks of seeds that ask for the rows of the nodes they come to."""
    blocks = seeds.withColumn("block", F.floor(F.col("s") / block))
    wanted = saved(blocks.select("block", "a").distinct())
    done, zero, none = None, F.lit(0.0), F.lit(0).cast("long")

    def run(table: pa.Table) -> pa.Table:
        part = {k: table.filter(pc.equal(table["kind"], k)) for k in "serut"}
        get = lambda k, *names: [part[k][c].to_numpy() for c in names]
        (s, a, w), (ea, eb, ex, em), (ra, rm), (ut, ub, um), (ta, tt, tx) = get("s", "g", "a", "x"), get("e", "a", "b", "x", "y"), get("r", "a", "x"), get("u", "a", "b", "x"), get("t", "a", "b", "x")
        names = np.unique(np.concatenate([a, ea, eb, ra, ub]))
        at = lambda v: np.searchsorted(names, v)
        most, known = np.zeros(len(names)), np.zeros(len(names), bool)
        most[at(eb)], most[at(ub)] = em, um
        most[at(ra)], known[at(ra)] = rm, True
        words = np.unique(np.concatenate([ut, tt]))
        rows = Rows(names, (at(ea), at(eb), ex), (at(ta), np.searchsorted(words, tt), tx), (np.searchsorted(words, ut), at(ub)), most, known)
        out, asked = [], set()
        for seed in np.unique(s):
            own = np.flatnonzero(s == seed)
            own = own[np.argsort(a[own])]
            nodes, masses, lacking = rows.push(at(a[own]), w[own], gamma, eps, top)
            asked |= lacking
            if not lacking:
                out.append((np.full(len(nodes), seed), names[nodes], masses))
        number = table["block"][0].as_py()
        more = names[sorted(asked)] if asked else np.zeros(0, np.int64)
        cols = [np.concatenate([*(o[i] for o in out), np.zeros(0)]) for i in range(3)]
        n = len(cols[0])
        return pa.table({"block": np.full(n + len(more), number), "seed": np.r_[cols[0].astype(np.int64), np.full(len(more), -1)], "node": np.r_[cols[1].astype(np.int64), more], "mass": np.r_[cols[2], np.zeros(len(more))]})

    finished = []
    while True:
        rows = wanted.join(graph.tops, "a").select("block", F.lit("r").alias("kind"), none.alias("g"), "a", none.alias("b"), F.col("most").alias("x"), zero.alias("y"))
        edges = wanted.join(graph.edges, "a").select("block", F.lit("e"), none, "a", "b", "share", "most")
        own = saved(wanted.join(graph.terms, "a"))
        terms = own.select("block", F.lit("t"), none, "a", F.col("t").cast("long"), "share", zero)
        stars = own.select("block", "t").distinct().join(graph.users, "t").select("block", F.lit("u"), none, F.col("t").cast("long"), "b", "most", zero)
        asks = blocks if done is None else blocks.join(done, "s", "left_anti")
        asking = asks.select("block", F.lit("s"), F.col("s"), "a", none, "w", zero)
        live = asking.select("block").distinct()
        every = rows.union(edges).union(terms).union(stars).join(live, "block", "left_semi").union(asking)
        got = saved(every.groupBy("block").applyInArrow(run, "block bigint, seed bigint, node bigint, mass double"))
        finished.append(got.where("seed >= 0").select("seed", "node", "mass"))
        more = got.where("seed < 0").select("block", F.col("node").alias("a"))
        if not more.limit(1).count():
            break
        now = finished[-1].select(F.col("seed").alias("s")).distinct()
        done = saved(now if done is None else done.union(now).distinct())
        wanted = saved(wanted.union(more).distinct())
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    return out


def push_lists(seeds: DataFrame, graph: PushGraph, gamma: float, eps: float = EPS, top: int = TOP, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(seed, near, captured) as a table, a row a seed of `seeds` (seed, id, w): the `top` largest masses (id, mass) in their order (ties, to 12
    digits, by name), and their sum."""
    if graph.size() <= limit:
        return saved(_pushed_whole(seeds, graph, gamma, eps, top))
    numbered, who = _numbered(seeds, graph)
    found = saved(_pushed_by_rows(numbered, graph, gamma, eps, top, block))
    named = found.join(graph.names, found.node == graph.names.g).select("seed", F.struct((-F.round("mass", 12)).alias("m"), "node", "id", "mass").alias("x"))
    lists = named.groupBy("seed").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("x.mass").alias("captured"))
    near = F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["mass"].alias("mass")))
    return saved(lists.join(who.withColumnRenamed("seed", "name"), lists.seed == who.s).select(F.col("name").cast("string").alias("seed"), near.alias("near"), "captured"))


def push_tops(seeds: DataFrame, graph: PushGraph, gamma: float, eps: float = EPS, top: int = TOP, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(seed, id, mass, r, captured): the rows of :func:`push_lists`, ranked."""
    return flat(push_lists(seeds, graph, gamma, eps, top, limit, block))


def flat(lists: DataFrame) -> DataFrame:
    found = lists.select("seed", "captured", F.posexplode("near").alias("at", "x"))
    return found.select("seed", "x.id", "x.mass", (F.col("at") + 1).alias("r"), "captured")
