"""Quotation linking: conversations without quoted text, ordered by replies.

1. Parse: the leading ``>`` signs of a line are its quote level; consecutive lines of
   a level are one passage, and a passage belongs to the message whose quote encloses
   it.  A line that announces a deeper quote (it ends in a colon, holds "wrote", "said"
   or "writes", and the next line that isn't blank is deeper) is an attribution and
   belongs to no passage, at whatever level.  A message's own text is its level-0 lines.
2. Link: passages are normalised (letters and digits in lower case, white space
   collapsed) and hashed as a whole, by paragraph, and by line (of ``LINE_WORDS`` words
   or more); so are the whole own text, the paragraphs and the lines of every message.
   An equality join within the conversation finds the original messages.  A trimmed
   quote links by what is left of it: the whole counts before a paragraph, a paragraph
   before a line; of several messages the latest one before the quoting one counts.
3. Order: a message replies to the original of its first outermost quote that links,
   else to the message before it (the earliest of a conversation has no parent).  A
   thread is read depth first: a chain of messages that each answer the one before,
   then the branches that quote back into it, the latest quoted message's first.

The join is on (conversation, hash), so a phrase common to many conversations makes no
group across them.  Messages are numbered by a range-partitioned global order and a
chain is found by a running maximum over ranges, so a conversation with a third of all
rows spreads over many tasks; branch paths climb by pointer doubling, in log2(nesting)
joins, and their length is the nesting of branches, not the number of messages.

Defined cases: null text has no lines; a null role is kept; a null conversation id is
a conversation of its own group, ordered by turn; messages repeated as whole rows
collapse to one; ties of turn are parted by role and text; very long texts are parsed
whole, in time that grows with their length; extra columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ranked, saved, small_batches

_marks = regex.compile(r"^[ \t]*((?:>[ \t]*)+)")
_attribution = regex.compile(r"\b(?:wrote|said|writes)\b.*:\s*$", regex.I)
_word = regex.compile(r"[\p{L}\p{N}]+")

LINE_WORDS = 4


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text of a message, and its quoted passages as (level, text) in order."""
    levels = []
    for line in (text or "").split("\n"):
        m = _marks.match(line)
        levels.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    # the level of the next line that isn't blank, from the end back
    ahead, following = [0] * len(levels), 0
    for k in range(len(levels) - 1, -1, -1):
        ahead[k] = following
        if levels[k][1].strip():
            following = levels[k][0]
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    open_level = 0
    for (level, body), deeper in zip(levels, ahead, strict=True):
        announces = deeper > level and _attribution.search(body)
        if level == 0:
            if not announces:
                own.append(body)
        elif level == open_level and quotes:
            quotes[-1][1].extend([] if announces else [body])
        else:
            quotes.append((level, [] if announces else [body]))
        open_level = level
    return "\n".join(own).strip(), [(lv, "\n".join(b).strip()) for lv, b in quotes if any(x.strip() for x in b)]


def quoted_parts(text: str) -> Iterator[tuple[int, int]]:
    """(rank, hash) of a quoted passage: the whole, its paragraphs, its longer lines."""
    seen = set()
    for rank, parts in enumerate(([text], text.split("\n\n"), text.split("\n"))):
        for part in parts:
            h = normalised_hash(part)
            if h is not None and h not in seen and (rank < 2 or len(_word.findall(part)) >= LINE_WORDS):
                seen.add(h)
                yield rank, h


def normalised_hash(text: str) -> int | None:
    words = _word.findall(text.lower())
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True) if words else None


def link(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, own text, number of quotes and of linked
    quotes, parent's turn, depth, and place in the conversation's reply order."""
    spark = messages.sparkSession
    small_batches(spark)
    base = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    conv, turn = (messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hashes, quotes, passages = [], [], [], []
            for text in batch.column(3).to_pylist():
                body, found = parse(text)
                own.append(body)
                parts = [body, *body.split("\n\n"), *body.split("\n")]
                hashes.append(sorted({h for p in parts if (h := normalised_hash(p)) is not None}))
                quotes.append([{"q": q, "level": lv, "rank": rank, "hash": h} for q, (lv, p) in enumerate(found) for rank, h in quoted_parts(p)])
                passages.append(sum(normalised_hash(p) is not None for _, p in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(passages, pa.int64()), pa.array(quotes, pa.list_(pa.struct([("q", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("hash", pa.int64())])))],
                names=["conv_id", "turn", "role", "own", "hashes", "n_quotes", "quotes"],
            )

    schema = f"conv_id {conv}, turn {turn}, role string, own string, hashes array<bigint>, n_quotes bigint, quotes array<struct<q:int,level:int,rank:int,hash:bigint>>"
    # g: the message's place among all messages, conversation by conversation
    numbered = saved(ranked(base.mapInArrow(run, schema), ["conv_id", "turn", "role", "own"], "messages"), "numbered")
    spans = saved(numbered.groupBy("conv_id").agg(F.min("g").alias("first"), F.max("g").alias("last")), "conversations")

    wanted = numbered.select("conv_id", "g", F.explode("quotes").alias("quote")).select("conv_id", "g", "quote.q", "quote.level", "quote.rank", F.col("quote.hash").alias("h"))
    held = numbered.select("conv_id", F.col("g"), F.explode("hashes").alias("h"))
    linked = _latest_before(wanted, held)
    parents = linked.groupBy("g").agg(F.count_distinct("q").alias("n_linked"), F.min_by("source", F.struct("level", "q", "rank", (-F.col("source")).alias("latest"))).alias("quoted"))
    # a message that quotes an earlier one than its neighbour opens a branch
    joined = numbered.join(parents, "g", "left").join(spans.withColumnRenamed("conv_id", "c3"), F.col("conv_id").eqNullSafe(F.col("c3"))).drop("c3")
    opens = (F.col("g") == F.col("first")) | (F.col("quoted") < F.col("g") - 1)
    nodes = saved(joined.withColumn("opens", F.coalesce(opens, F.lit(False))), "replies")

    # each message's chain is the last branch opened at or before it
    chains = _last_open(nodes.select("g", "opens"))
    starts = saved(
        nodes.where("opens").select(F.col("g").alias("start"), F.when(F.col("g") > F.col("first"), F.col("quoted")).alias("source"))
        .join(chains.select(F.col("g").alias("source"), F.col("chain").alias("up")), "source", "left").select("start", "source", "up"),
        "branches",
    )
    # paths of branches by pointer doubling: `up` is the branch 2**k levels above
    steps = F.when(F.col("source").isNull(), F.array().cast("array<struct<back:bigint,start:bigint>>")).otherwise(F.array(F.struct((-F.col("source")).alias("back"), F.col("start").alias("start"))))
    paths = starts.select("start", "up", steps.alias("path"), F.when(F.col("source").isNull(), 0).otherwise(F.col("source") - F.col("up") + 1).cast("long").alias("depth"))
    while paths.where(F.col("up").isNotNull()).limit(1).count():
        above = paths.select(F.col("start").alias("s2"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        more = paths.join(above, F.col("up") == F.col("s2"), "left")
        paths = saved(more.select("start", F.col("up2").alias("up"), F.when(F.col("s2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "branch-paths")

    placed = nodes.join(chains, "g").join(paths.select(F.col("start").alias("chain"), "path", "depth"), "chain")
    laid = placed.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "first", "g", "n_linked", "path", "n_quotes",
        F.when(F.col("g") > F.col("first"), F.coalesce("quoted", F.col("g") - 1)).alias("parent"), (F.col("depth") + F.col("g") - F.col("chain")).alias("depth"),
    )
    final = ranked(laid, ["first", "path", "g"], "reply-order", "place")
    return final.select(
        "conv_id",
        "turn",
        "role",
        "text",
        (F.col("g") - F.col("first") + 1).alias("message"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        (F.col("parent") - F.col("first") + 1).alias("reply_to"),
        "depth",
        (F.col("place") - F.col("first") + 1).alias("reply_order"),
    )


def _latest_before(quotes: DataFrame, held: DataFrame) -> DataFrame:
    """(g, q, level, rank, source): for each hash of a quote the latest earlier message of its conversation
    that holds its hash.  One sorted pass over quotes and holders together, so a passage
    that is quoted often and held often costs its rows, not their product."""
    none = F.lit(None)
    quotes = quotes.join(held.select("conv_id", "h").distinct(), [quotes.conv_id.eqNullSafe(held.conv_id), quotes.h == held.h], "left_semi")
    rows = quotes.select("conv_id", "h", "g", F.lit(0).alias("kind"), "q", "level", "rank").union(held.select("conv_id", "h", "g", F.lit(1), *[none.cast("int")] * 3))
    order = saved(ranked(rows, ["conv_id", "h", "g", "kind", "q"], "quotes", "place"), "quotes-placed")
    groups = order.groupBy("conv_id", "h").agg(F.min("place").alias("low")).withColumnsRenamed({"conv_id": "c2", "h": "h2"})
    last = _last_open(order.select(F.col("place").alias("g"), (F.col("kind") == 1).alias("opens"))).withColumnsRenamed({"g": "place", "chain": "at"})
    asked = order.where("kind = 0").join(last, "place").join(groups, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("h") == F.col("h2"))).where("at >= low")
    holders = order.where("kind = 1").select(F.col("place").alias("at"), F.col("g").alias("source"))
    return asked.join(holders, "at").select("g", "q", "level", "rank", "source")


def _last_open(nodes: DataFrame) -> DataFrame:
    """(g, chain): the greatest g' <= g with `opens`, by a running maximum over ranges of g."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            open_ = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            chain = np.maximum.accumulate(np.r_[last, np.where(open_, g, -1)])[1:]
            last = int(chain[-1]) if len(chain) else last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chain, pa.int64())], names=["g", "chain"])

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = nodes.repartitionByRange(parts, "g").sortWithinPartitions("g").mapInArrow(run, "g bigint, chain bigint").withColumn("p", F.spark_partition_id())
    local = saved(local, "chains")
    tops = sorted((r["p"], r["top"]) for r in local.groupBy("p").agg(F.max("chain").alias("top")).collect())
    carry, rows = -1, []
    for p, top in tops:
        rows.append((p, carry))
        carry = max(carry, top)
    before = spark.createDataFrame(rows or [(0, -1)], "p int, carried bigint")
    return local.join(F.broadcast(before), "p").select("g", F.greatest("chain", "carried").alias("chain"))
