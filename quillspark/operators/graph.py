"""Graph operators: typed edges, walks, PageRank and personalised diffusion.

Iterations write each round (or every few) to the shared folder, so plans stay short
and a lost executor costs nothing.

Provisions that use a term are all neighbours of each other, which would be quadratic as
edges.  :class:`Mixed` keeps such a clique as a star: a step of a :class:`~quillspark.operators.walk.Walk` collects what a
term's users hold, hands it back to them and takes each one's own share off, which is the
same product with the same numbers and as many rows as there are uses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.hierarchy import belongs_to
from quillspark.operators.ordering import ranked
from quillspark.operators.push import EPS, TOP, Coded, PushGraph, push_tops
from quillspark.operators.tables import saved
from quillspark.operators.walk import Walk

# Fixed values that decide results.
WEIGHT = {"cit": 0.45, "hier": 0.20, "term": 0.20, "sem": 0.05}
SIBLING_WEIGHT = 0.8
GAMMA_BASELINE, GAMMA_QUERY = 0.50, 0.55
PAGERANK_DAMPING = 0.85
PER_TERM = 200
BASELINE_ROUNDS, PAGERANK_ROUNDS, DIFFUSION_ROUNDS = 50, 100, 20
LOCAL_NODES, LOCAL_EDGES, NEIGHBOURS = 5000, 40000, 80
#: More seeds than these without a fingerprint are pushed together.
JOINT = 3
#: Edges of the longest path up to which PageRank is a sum over paths.
DEPTH = 8


def citation_edges(refs: DataFrame) -> DataFrame:
    """(src, dst, w): resolved citations by count; own ones and external ones drop out."""
    known = refs.where("target_internal_id IS NOT NULL AND target_internal_id <> source_internal_id")
    return known.groupBy(F.col("source_internal_id").alias("src"), F.col("target_internal_id").alias("dst")).agg(F.count("*").cast("double").alias("w"))


def adjacent_siblings(p: DataFrame) -> DataFrame:
    """(a, b): neighbours in sibling order under one parent; roots are siblings of each other.
    Places are counted over range partitions, so a wide parent is no task of its own."""
    order = [F.asc_nulls_first("parent_internal_id"), F.asc_nulls_last("sibling_order"), F.asc("internal_id")]
    rows = ranked(p.select("internal_id", "parent_internal_id", "sibling_order"), order, "at")
    one = rows.select(F.col("internal_id").alias("a"), F.col("parent_internal_id").alias("up"), "at")
    two = rows.select(F.col("internal_id").alias("b"), F.col("parent_internal_id").alias("other"), (F.col("at") - 1).alias("at"))
    return one.join(two, "at").where(F.col("up").eqNullSafe(F.col("other"))).select("a", "b")


def hierarchy_edges(p: DataFrame) -> DataFrame:
    up = p.where("parent_internal_id IS NOT NULL").select(F.col("internal_id").alias("a"), F.col("parent_internal_id").alias("b"), F.lit(1.0).alias("w"))
    side = adjacent_siblings(p).withColumn("w", F.lit(SIBLING_WEIGHT))
    one = up.union(side)
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(one.select("b", "a", "w"))


def term_idf(terms: DataFrame) -> DataFrame:
    """(term, df, idf): sources a term, and 1 / ln(1 + df) held to 0.2..2."""
    by = terms.groupBy(F.lower(F.trim("term_text")).alias("term")).agg(F.count_distinct("source_internal_id").alias("df"))
    return _idf(by)


def _idf(by: DataFrame) -> DataFrame:
    return by.withColumn("idf", F.greatest(F.lit(0.2), F.least(F.lit(2.0), 1 / F.log(1.0 + F.col("df")))))


def term_uses(terms: DataFrame) -> DataFrame:
    """(id, term, df, idf): one row a provision and term."""
    users = terms.select(F.lower(F.trim("term_text")).alias("term"), F.col("source_internal_id").alias("id")).distinct()
    return users.join(term_idf(terms), "term").select("id", "term", "df", "idf")


def term_links(terms: DataFrame) -> DataFrame:
    """(id, terms, links, w): a provision's row of the co-usage matrix, summed up: the pairs it
    forms with other users of its terms, and their weight."""
    return term_uses(terms).groupBy("id").agg(F.count("*").alias("terms"), F.sum(F.col("df") - 1).alias("links"), F.sum(F.col("idf") * (F.col("df") - 1)).alias("w"))


def term_cooccurrence(terms: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """(a, b, terms, w), a < b: provisions that share terms, over the first `per_term` users of
    each term by id.  For the local graph of a query, whose size is bounded; the whole graph
    needs no pairs (see :class:`Mixed`)."""
    users = terms.select(F.lower(F.trim("term_text")).alias("term"), F.col("source_internal_id").alias("id")).distinct()
    # two steps: the least of each bucket, then of the term, so a term used everywhere is no hot task
    bucket = Window.partitionBy("term", "bucket").orderBy("id")
    few = users.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(bucket)).where(F.col("r") <= per_term)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("id"))).where(F.col("r") <= per_term).select("term", "id")
    idf = term_idf(terms).select("term", "idf")
    left, right = few.withColumnRenamed("id", "a").join(idf, "term"), few.withColumnRenamed("id", "b")
    return left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("terms"), F.sum("idf").alias("w"))


@dataclass
class Mixed:
    """The weighted views of a corpus as tables.

    ``direct`` (id, node, w): edges of citations and hierarchy; ``uses`` (id, term, w, df): what a node's
    use of a term weighs for each of the term's other users, of nodes only; ``totals`` (id, total): the
    weight of a node's whole row.  A node without a row links to itself."""

    nodes: DataFrame
    direct: DataFrame
    uses: DataFrame
    totals: DataFrame
    _coded: Coded | None = None
    _push: PushGraph | None = None

    @staticmethod
    def of(p: DataFrame, refs: DataFrame, terms: DataFrame) -> Mixed:
        nodes = saved(p.select(F.col("internal_id").alias("id")).distinct())
        known = refs.where("target_internal_id IS NOT NULL AND target_internal_id <> source_internal_id")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        cited = known.select(F.col("source_internal_id").alias("src"), F.col("target_internal_id").alias("dst"), one.alias("n"), F.lit(0.0).alias("w"))
        views = cited.union(hierarchy_edges(p).select("src", "dst", none, F.col("w") * WEIGHT["hier"]))
        # users that are no nodes count neither in a term's frequency nor in anybody's row
        own = terms.select(F.lower(F.trim("term_text")).alias("term"), F.col("source_internal_id").alias("id")).repartition("id").join(nodes, "id", "left_semi")
        users = saved(own.distinct())
        idf = saved(_idf(users.groupBy("term").agg(F.count("*").alias("df"))).where("df > 1"))
        uses = users.join(idf, "term").select("id", "term", (WEIGHT["term"] * F.col("idf")).alias("w"), "df")
        return Mixed._linked(nodes, views, uses, F.sum("n") * WEIGHT["cit"] + F.sum("w"))

    @staticmethod
    def plain(nodes: DataFrame, edges: DataFrame) -> Mixed:
        """A graph of (src, dst, w) edges alone."""
        nodes = saved(nodes.select("id").distinct())
        none = nodes.select("id", F.lit("").alias("term"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("df")).limit(0)
        return Mixed._linked(nodes, edges, none, F.sum("w"))

    @staticmethod
    def _linked(nodes: DataFrame, edges: DataFrame, uses: DataFrame, weight: Column) -> Mixed:
        # dealt by the source last, so pairs are summed up where they are, and a file has all edges of its sources
        known = edges.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").repartition("src").join(nodes.withColumnRenamed("id", "src"), "src", "left_semi")
        direct = saved(known.groupBy("src", "dst").agg(weight.alias("w")).where("w > 0").select(F.col("src").alias("id"), F.col("dst").alias("node"), "w"))
        weights = direct.select("id", "w").union(uses.select("id", F.col("w") * (F.col("df") - 1)))
        totals = saved(weights.groupBy("id").agg(F.sum("w").alias("total")).where("total > 0"))
        return Mixed(nodes, direct, uses, totals)

    def rows(self) -> DataFrame:
        """(src, dst, via, p): the transition matrix; a row through a term (via = 'term', dst = its
        text) stands for equal shares to the term's other users.  Rows of a node sum to one."""
        edge = self.direct.join(self.totals, "id").select(F.col("id").alias("src"), F.col("node").alias("dst"), F.lit("edge").alias("via"), (F.col("w") / F.col("total")).alias("p"))
        star = self.uses.join(self.totals, "id").select(F.col("id").alias("src"), F.col("term").alias("dst"), F.lit("term"), F.col("w") * (F.col("df") - 1) / F.col("total"))
        alone = self.nodes.join(self.totals, "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("self"), F.lit(1.0))
        return edge.union(star).union(alone)

    def coded(self) -> Coded:
        """The views by numbers, made once."""
        if self._coded is None:
            self._coded = Coded.of(self.nodes, self.direct, self.uses, self.totals)
        return self._coded

    def push_graph(self) -> PushGraph:
        """The rows for forward push, made once."""
        if self._push is None:
            self._push = PushGraph.of(self.coded())
        return self._push


def walk_of(graph: Mixed) -> Walk:
    """A clique of a term's users is a star: what they hold is collected at the term, handed back to
    all, and each one's own use of it takes its share off again."""
    coded = graph.coded()
    share = F.col("w") / F.col("total")
    using = coded.used.join(coded.whole, "a")
    to_node = coded.pairs.join(coded.whole, "a").select("a", "b", share.alias("p"))
    own = using.groupBy("a").agg(F.sum(-share).alias("p")).select("a", F.col("a").alias("b"), "p")
    alone = coded.names.select(F.col("g").alias("a")).join(coded.whole, "a", "left_anti").select("a", F.col("a").alias("b"), F.lit(1.0).alias("p"))
    return Walk(coded.names, to_node.union(own).union(alone), using.select("a", "t", (1 / F.col("total")).alias("p")), coded.used.select(F.col("a").alias("b"), "t", "w"))


#: The walk of a graph of views.
Walk.of = staticmethod(walk_of)


def power_iteration(graph: Mixed, gamma: float, rounds: int = BASELINE_ROUNDS, tolerance: float = 1e-14) -> DataFrame:
    """(id, pi): the settled masses of the whole graph, normalised at the end."""
    pi = walk_of(graph).settled(gamma, rounds, tolerance)
    total = pi.agg(F.sum("x")).first()[0] or 1.0
    return pi.select("id", (F.col("x") / F.lit(total)).alias("pi"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = PAGERANK_DAMPING, rounds: int = PAGERANK_ROUNDS, tolerance: float = 1e-13) -> DataFrame:
    """(id, rank): PageRank over (src, dst); what ends in nodes without outgoing edges is spread
    evenly, as by a term that those nodes link to and all nodes use.

    What a round spreads evenly is one number, so the ranks are a sum over how many edges a mass has come along.  Where no
    path is longer than ``DEPTH`` edges, those sums are made once and the rounds are arithmetic on their totals (see
    :func:`_paths`); other graphs are walked."""
    if getattr(edges, "_table", None) is None:
        edges = saved(edges.select("src", "dst"))
    nodes = saved(nodes.select("id").distinct())
    n = max(nodes.count(), 1)
    out = saved(edges.groupBy(F.col("src").alias("id")).agg((1 / F.count("*")).alias("p")).join(nodes, "id", "left_semi"))
    paths = _paths(nodes, edges, out)
    if paths is not None:
        return _ranks(nodes, n, paths, n - out.count(), damping, rounds)
    names = saved(ranked(nodes, ["id"], "g").select("id", "g"))
    out = saved(out.join(names, "id").select("id", F.col("g").alias("a"), "p"))
    links = edges.join(out.withColumnRenamed("id", "src"), "src").join(names.select(F.col("id").alias("dst"), F.col("g").alias("b")), "dst").select("a", "b", "p")
    every = names.select(F.col("g").alias("a"))
    ends = every.join(out, "a", "left_anti").select("a", F.lit(0).alias("t"), F.lit(1.0 / n).alias("p"))
    walk = Walk(names, links, ends, every.select(F.col("a").alias("b"), F.lit(0).alias("t"), F.lit(1.0).alias("w")))
    return walk.settled(damping, rounds, tolerance).withColumnRenamed("x", "rank")


def _paths(nodes: DataFrame, edges: DataFrame, out: DataFrame) -> list[tuple[DataFrame, float]] | None:
    """For 1, 2, ... edges what arrives (id, x) when every node starts with one and passes it on in equal parts (out: id, p), and the
    sum of what has arrived at nodes without outgoing edges.  None if there are paths longer than ``DEPTH``."""
    front, found = out.select(F.col("id").alias("src"), "p"), []
    for _ in range(DEPTH):
        got = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("p").alias("x")).join(nodes, "id", "left_semi")
        got = saved(got.join(out, "id", "left"))
        going, lost = got.agg(F.count("p"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("x"))), F.lit(0.0))).first()
        found.append((got.select("id", "x"), lost))
        if not going:
            return found
        front = got.where("p IS NOT NULL").select(F.col("id").alias("src"), (F.col("x") * F.col("p")).alias("p"))
    return None


def _ranks(nodes: DataFrame, n: int, paths: list[tuple[DataFrame, float]], ends: int, damping: float, rounds: int) -> DataFrame:
    """(id, rank) after `rounds` rounds from the uniform start.  After m rounds what came along j edges (j <= m) counts
    damping^j * even[m - j], where even[k] is what each node gets evenly in round k."""
    lost = [float(ends), *(x for _, x in paths)]
    even = [1.0 / n]
    for m in range(rounds):
        dangling = sum(damping**j * even[m - j] * lost[j] for j in range(min(m + 1, len(lost))))
        even.append((1 - damping + damping * dangling) / n)
    every = nodes.select("id", F.lit(even[rounds]).alias("x"))
    for j, (got, _) in enumerate(paths[:rounds], 1):
        every = every.union(got.select("id", F.col("x") * (damping**j * even[rounds - j])))
    return saved(every.groupBy("id").agg(F.sum("x").alias("rank")))


def diffuse(seeds: DataFrame, graph: Mixed, gamma: float, rounds: int = DIFFUSION_ROUNDS, every: int = 3) -> DataFrame:
    """(seed, id, mass): personalised diffusion by `rounds` exact steps, for several seeds at once.

    seeds: (seed, id, w) with weights that sum to one a seed."""
    return walk_of(graph).diffused(seeds, gamma, rounds, every)


def push_masses(seeds: DataFrame, graph: Mixed, gamma: float = GAMMA_BASELINE, eps: float = EPS, top: int = TOP) -> DataFrame:
    """(seed, id, mass, r, captured) by forward push with a queue a seed; the `top` largest masses of each.

    seeds: (seed, id, w)."""
    return push_tops(seeds, graph.push_graph(), gamma, eps, top)


def within_hops(seeds: DataFrame, refs: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes reached from `seeds` (id) over citations in either direction."""
    known = refs.where("target_internal_id IS NOT NULL").select(F.col("source_internal_id").alias("a"), F.col("target_internal_id").alias("b")).distinct()
    both = known.union(known.select("b", "a")).toDF("a", "b")
    seen = saved(seeds.select("id", F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, hops + 1):
        reached = both.join(front, both.a == front.id).select(F.col("b").alias("id")).distinct()
        front = saved(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
    return seen


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id): all that `start` (root, id) reaches over (src, dst), itself included.  Cycles
    end because a round keeps only pairs that are new; it goes on until there are none.  Every round reads the edges, so they are a table."""
    if getattr(edges, "_table", None) is None:
        edges = saved(edges.select("src", "dst"))
    front = saved(start.select("root", "id").distinct())
    fronts = [front]
    while True:
        seen = fronts[0]
        for f in fronts[1:]:
            seen = seen.union(f)
        front = saved(front.join(edges, front.id == edges.src).select("root", F.col("dst").alias("id")).distinct().join(seen, ["root", "id"], "left_anti"))
        if not front.limit(1).count():
            return seen
        fronts.append(front)
        if len(fronts) > 16:  # a long chain: keep plans short
            fronts = [saved(seen.union(front))]


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first `n` rows of each key: of each bucket first, so that a hot key is no hot task."""
    near = df.withColumn("_b", F.pmod(F.xxhash64("src", "dst"), F.lit(64)))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))).where(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_b")


@dataclass
class Local:
    """The graphs around some groups of seeds, side by side: ``nodes`` (grp, id), ``edges`` (grp, src, dst, w)."""

    nodes: DataFrame
    edges: DataFrame


def local_graph(seeds: DataFrame, p: DataFrame, refs: DataFrame, terms: DataFrame, near: DataFrame | None = None, act: str | None = None, excluded: DataFrame | None = None) -> Local:
    """The graph around each group of seeds (grp, id), of `act`'s provisions (all without one) but `excluded` ones (id).

    * Citations of the frontier, either way, in two rounds (the second only below ``LOCAL_NODES`` nodes); one that both
      rounds meet counts in both; at most ``LOCAL_EDGES``, by round, then by ids.
    * Of every node so far its parent, and of those parents all children and adjacent siblings, both ways; the link of such a node
      to its parent counts twice.
    * Of the *seeds'* terms, as they are written, all users as nodes, and pairs of the first ``PER_TERM`` users by id.
    * `near` (id, other, r): the seeds' nearest neighbours, nodes as well, while both budgets last."""
    key = ["grp", "id"]

    def allowed(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.where(belongs_to(F.col(c), act))
            if excluded is not None:
                df = df.join(excluded.select(F.col("id").alias(c)).distinct(), c, "left_anti")
        return df

    seeds = saved(allowed(seeds.select(*key).distinct(), "id"))
    known = refs.where("target_internal_id IS NOT NULL").select(F.col("source_internal_id").alias("src"), F.col("target_internal_id").alias("dst"))
    known = saved(allowed(known, "src", "dst"))
    nodes, front, cited = seeds, seeds, None
    for hop in range(2):
        # a citation within the frontier is met once
        out = known.join(front.select("grp", F.col("id").alias("src")), "src").select("grp", "src", "dst")
        into = known.join(front.select("grp", F.col("id").alias("dst")), "dst").join(front.select("grp", F.col("id").alias("src")), ["grp", "src"], "left_anti").select("grp", "src", "dst")
        met = saved(out.union(into).withColumn("hop", F.lit(hop)))
        cited = met if cited is None else cited.union(met)
        ends = met.select("grp", F.col("src").alias("id")).union(met.select("grp", "dst")).distinct()
        front = ends.join(front, key, "left_anti")
        nodes = saved(nodes.union(ends).distinct())
        small = nodes.groupBy("grp").count().where(F.col("count") < LOCAL_NODES).select("grp")
        front = saved(front.join(small, "grp", "left_semi"))
    cited = saved(_first(cited, "grp", ["hop", "src", "dst"], LOCAL_EDGES).select("grp", "src", "dst"))
    # what a budget cut off is no node either
    nodes = saved(seeds.union(cited.select("grp", "src")).union(cited.select("grp", "dst")).distinct())

    own = saved(allowed(p.select("internal_id", "parent_internal_id", "sibling_order"), "internal_id"))
    up = own.where("parent_internal_id IS NOT NULL").select(F.col("internal_id").alias("id"), F.col("parent_internal_id").alias("up"))
    parents = saved(allowed(nodes.join(up, "id").select("grp", "id", "up"), "up"))
    tops = parents.select("grp", "up").distinct()
    kids = tops.join(up, "up").select("grp", "id", "up")
    side = adjacent_siblings(own).join(up, F.col("a") == F.col("id")).select("a", "b", "up")
    side = tops.join(side, "up").select("grp", F.col("a").alias("src"), F.col("b").alias("dst"))
    hier = parents.select("grp", F.col("id").alias("src"), F.col("up").alias("dst")).union(kids.select("grp", "id", "up")).union(side)
    nodes = saved(nodes.union(tops).union(kids.select(*key)).distinct())

    uses = allowed(terms.where("term_text <> ''").select(F.col("source_internal_id").alias("id"), F.col("term_text").alias("term")).distinct(), "id")
    asked = uses.join(seeds, "id").select("grp", "term").distinct()
    users = saved(uses.join(asked, "term").select("grp", "term", "id"))
    few = users.select("grp", F.concat_ws("\u0001", "grp", "term").alias("t"), F.col("id").alias("src"), F.lit("").alias("dst"))
    few = saved(_first(few, "t", ["src"], PER_TERM).select("grp", "t", "src"))
    pairs = few.join(few.select("t", F.col("src").alias("dst")), "t").where("src < dst").select("grp", "src", "dst")
    nodes = nodes.union(users.select(*key)).distinct()

    def both(df: DataFrame, w: float) -> DataFrame:
        return df.select("grp", "src", "dst", F.lit(w).alias("w")).union(df.select("grp", "dst", "src", F.lit(w)))

    edges = cited.select("grp", "src", "dst", F.lit(WEIGHT["cit"]).alias("w")).union(both(hier, WEIGHT["hier"])).union(both(pairs, WEIGHT["term"]))
    if near is not None:
        edges, nodes = saved(edges), saved(nodes)
        size = nodes.groupBy("grp").agg(F.count("*").alias("n")).join(edges.groupBy("grp").agg(F.count("*").alias("m")), "grp", "left")
        # a seed has a bounded number of neighbours, and a group of seeds few seeds
        found = allowed(seeds.join(near, "id").select("grp", "id", "other", "r"), "other")
        had = nodes.withColumnsRenamed({"id": "other"}).withColumn("had", F.lit(1))
        line = Window.partitionBy("grp").orderBy("id", "r", "other")
        first = F.row_number().over(Window.partitionBy("grp", "other").orderBy("id", "r")) == 1
        found = found.join(had, ["grp", "other"], "left").withColumn("new", (F.col("had").isNull() & first).cast("int")).join(size, "grp")
        found = found.withColumn("before", F.sum("new").over(line) - F.col("new")).withColumn("place", F.row_number().over(line) - 1)
        kept = saved(found.where((F.col("n") + F.col("before") < LOCAL_NODES) & (F.coalesce("m", F.lit(0)) + 2 * F.col("place") < LOCAL_EDGES)).select("grp", F.col("id").alias("src"), F.col("other").alias("dst")))
        edges, nodes = edges.union(both(kept, WEIGHT["sem"])), nodes.union(kept.select("grp", "dst")).distinct()
    return Local(saved(nodes), saved(edges.groupBy("grp", "src", "dst").agg(F.sum("w").alias("w"))))


def local_fingerprints(seeds: DataFrame, local: Local, top: int = TOP) -> DataFrame:
    """(grp, id, mass, captured): each group's weighted seeds (grp, id, w) pushed together over its local graph;
    the `top` masses, the seeds' own left out."""
    name = lambda c: F.concat_ws("\u0001", "grp", c)
    graph = Mixed.plain(local.nodes.select(name("id").alias("id")), local.edges.select(name("src").alias("src"), name("dst").alias("dst"), "w"))
    total = seeds.groupBy("grp").agg(F.sum("w").alias("total"))
    asked = seeds.join(total, "grp").select(F.col("grp").alias("seed"), name("id").alias("id"), (F.col("w") / F.col("total")).alias("w"))
    found = push_masses(asked, graph, GAMMA_QUERY, top=top)
    plain = found.select(F.col("seed").alias("grp"), F.element_at(F.split("id", "\u0001"), -1).alias("id"), "mass", "captured")
    return plain.join(seeds.select("grp", "id"), ["grp", "id"], "left_anti")


def missing_groups(missing: DataFrame) -> DataFrame:
    """(grp, act_id, seed, w, share): how seeds (act_id, id, w) without a fingerprint are pushed.  Up to ``JOINT`` of an act
    each have a group of their own; more are one group, whose masses count by their `share`, the sum of the weights."""
    n = missing.groupBy("act_id").agg(F.count("*").alias("n"), F.sum("w").alias("all_w"))
    alone = F.col("n") <= JOINT
    grp = F.when(alone, F.concat_ws("|", "act_id", "id")).otherwise(F.col("act_id"))
    return missing.join(n, "act_id").select(grp.alias("grp"), "act_id", F.col("id").alias("seed"), "w", F.when(alone, F.col("w")).otherwise(F.col("all_w")).alias("share"))


def stored_or_pushed(seeds: DataFrame, stored: DataFrame, graph: Mixed, gamma: float = GAMMA_BASELINE, eps: float = EPS) -> DataFrame:
    """(seed, id, mass) of `seeds` (seed): read from `stored` fingerprints where there are some,
    pushed for the others (a read-through cache; the caller publishes what is new)."""
    hit = stored.join(seeds.select("seed"), "seed", "left_semi").select("seed", "id", "mass")
    missing = seeds.join(stored.select("seed").distinct(), "seed", "left_anti").select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("w"))
    return hit.union(push_masses(missing, graph, gamma, eps).select("seed", "id", "mass"))


def top_masses(masses: DataFrame, top: int = TOP) -> DataFrame:
    """(seed, id, mass, r, captured): the `top` masses of each seed (ties, to 12 digits, by id) and their sum."""
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("mass", 12)), "id")
    best = masses.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    return best.withColumn("captured", F.sum("mass").over(Window.partitionBy("seed")))
