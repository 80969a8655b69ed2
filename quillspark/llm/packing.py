"""Sequence packing by non-negative least squares over a length histogram.

Documents are tokenised once, in the scan, and packed in blocks of about
``block_tokens`` token ids as they stream by, so a task holds one block however
large its partition is, nothing is shuffled and the driver sees no data.

For each block:

1. every document is cut into full windows of ``window`` ids, each a sequence of
   its own, and a remainder shorter than a window;
2. the remainders are counted in a histogram whose bins are ``window / bins`` ids
   wide (a length counts in the bin that holds it rounded up);
3. all combinations of at most ``depth`` bins that fill the window exactly are
   enumerated, and how often each should be used is the non-negative least
   squares solution against the histogram (active sets, in numpy);
4. the repeat counts are rounded to the nearest number (a combination is used no more
   often than its bins have remainders left), the planned sequences are filled with the
   remainders of their bins, and what the bins' rounding up left free in a sequence is
   filled with ids cut from the residual documents;
5. residual remainders are packed greedily, one after another, cut where a
   sequence is full.  The last, partly filled sequence stays open for the next
   block, so a task pads at most one sequence.

Defined cases: a null or empty text is one end id; repeated rows are packed once
per row; a very long text is cut over as many sequences as it needs; ids are
placed exactly once; the strings of special tokens become those tokens, as they do in
the tokenizer; a null id is carried like others; ties of length go by arrival; an empty
table gives an empty result; extra input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_column, small_batches
from quillspark.llm.textkit import offsets_of

WINDOW = 2048
END_ID = 1


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The ids that ``tokenizers`` gives for a vocabulary file (add_special_tokens=False).

    ``tokenizers`` alone needs more CPU than there is for this (see the README), so texts go
    through the same byte-level BPE in ``tiktoken`` where that is safe: a text that holds an
    added token's string goes to ``tokenizers``, and so does everything unless both agree on
    a probe and on every entry of the vocabulary.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = (spec["model"].get("type"), (spec.get("pre_tokenizer") or {}).get("type"), spec.get("normalizer"), spec["model"].get("ignore_merges"))
    if kinds != ("BPE", "ByteLevel", None, False):
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    quick = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(texts: list[str]) -> list[list[int]]:
        odd = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        out = [[] if i in odd else quick.encode_ordinary(t) for i, t in enumerate(texts)]
        for i, ids in zip(odd, plain([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    entries = [b.decode(errors="ignore") for b in ranks]
    probe = ["It's 3.14,\tnaïve über 12345!\n\n  x  <|endoftext|>", "你好 \U0001f600 ...  \r\n a_b 'll ''t", "", "the thetion ndering", *entries, *("x" + e for e in entries[::50])]
    return by_ranks if by_ranks(probe) == plain(probe) else plain


@lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Every multiset of at most `depth` bin sizes in 1..bins with sum `bins`, as rows of use counts."""
    rows: list[np.ndarray] = []

    def extend(left: int, largest: int, parts: list[int]) -> None:
        if left == 0:
            rows.append(np.bincount(parts, minlength=bins + 1)[1:])
        elif len(parts) < depth:
            for part in range(min(left, largest), 0, -1):
                if part * (depth - len(parts)) < left:
                    break
                extend(left - part, part, [*parts, part])

    extend(bins, bins, [])
    return np.array(rows, float)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| with x >= 0 by active sets (Lawson and Hanson)."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds or 3 * n):
        slope = right - gram @ x
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tiny or free.sum() >= m:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            steps = x[own][low] / np.maximum(x[own][low] - z[low], 1e-300)
            move = float(steps.min(initial=1.0))
            new = x[own] + move * (z - x[own])
            new[low & (x[own] / np.maximum(x[own] - z, 1e-300) <= move)] = 0
            x[own] = np.maximum(new, 0)
            free[own[x[own] <= 1e-12]] = False
            if not free.any():
                return x
        x[:] = 0
        x[own] = z
    return x


class _Packer:
    """Packs blocks of (row, length) into sequences; `open_used` ids lie in the open sequence."""

    def __init__(self, window: int, bins: int, depth: int, first_sequence: int) -> None:
        self.window, self.bins, self.depth = window, bins, depth
        self.next = first_sequence
        self.open, self.open_used = None, 0

    def take(self) -> int:
        self.next += 1
        return self.next - 1

    def pack(self, lengths: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Pieces (document, start, length, sequence, offset) for documents of these lengths."""
        window, out = self.window, []
        for i in np.flatnonzero(lengths >= window):
            for k in range(int(lengths[i]) // window):
                out.append((int(i), k * window, window, self.take(), 0))
        rest = lengths % window
        width = window // self.bins
        bin_of = -(-rest // width)  # 1..bins; 0: nothing left
        members = {b: np.flatnonzero(bin_of == b).tolist() for b in range(1, self.bins + 1)}
        counts = np.array([len(members[b]) for b in range(1, self.bins + 1)], float)
        plan: list[list[int]] = []
        if counts.sum():
            combos = combinations(self.bins, self.depth)
            combos = combos[((combos > 0) & (counts == 0)).sum(1) == 0]
            if len(combos):
                repeats = np.rint(nnls(combos.T, counts)).astype(int)
                for c in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
                    use = combos[c].astype(int)
                    fit = min(int(repeats[c]), *(len(members[b + 1]) // use[b] for b in np.flatnonzero(use)))
                    for _ in range(fit):
                        plan.append([members[b + 1].pop() for b in np.flatnonzero(use) for _ in range(use[b])])
        residual = [i for b in range(self.bins, 0, -1) for i in members[b]]
        begin = {i: int(lengths[i] - rest[i]) for i in residual}
        left = {i: int(rest[i]) for i in residual}

        def cut(n: int, sequence: int, offset: int) -> int:
            """Up to n ids of the residual documents into a sequence."""
            done = 0
            while done < n and residual:
                i = residual[-1]
                size = min(left[i], n - done)
                out.append((i, begin[i], size, sequence, offset + done))
                begin[i] += size
                left[i] -= size
                done += size
                if not left[i]:
                    residual.pop()
            return done

        for group in plan:
            sequence, offset = self.take(), 0
            for i in group:
                out.append((i, int(lengths[i] - rest[i]), int(rest[i]), sequence, offset))
                offset += int(rest[i])
            cut(window - offset, sequence, offset)
        while residual:
            if self.open is None or self.open_used == window:
                self.open, self.open_used = self.take(), 0
            self.open_used += cut(window - self.open_used, self.open, self.open_used)
        return out


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, bins: int = 64, depth: int = 3, block_tokens: int = 3_000_000) -> DataFrame:
    """Pack documents into sequences of at most `window` token ids.

    One row per piece: the document's id, where the piece starts among its ids,
    its length, its ids (``ids``, little-endian unsigned 32-bit), their crc32, the
    document's number of ids, and the piece's sequence and offset there.
    """
    if window % bins:
        raise ValueError("bins must divide window")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        context = TaskContext.get()
        packer = _Packer(window, bins, depth, (context.partitionId() if context else 0) << 36)
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = pa.concat_arrays(keys)
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = packer.pack(lengths)
            for a in range(0, len(pieces), 4000):
                part = pieces[a : a + 4000]
                cols = np.array(part, np.int64)
                data = [ids[i][s : s + n].tobytes() for i, s, n, _, _ in part]
                arrays = [key.take(pa.array(cols[:, 0])), cols[:, 1], cols[:, 2], np.array([zlib.crc32(x) for x in data], np.int64), lengths[cols[:, 0]], cols[:, 3], cols[:, 4]]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in arrays] + [binary_column(b"".join(data), offsets_of(4 * cols[:, 2]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                for got in encode([t or "" for t in part.column(1).to_pylist()]):
                    got.append(end_id)
                    ids.append(np.array(got, "<u4"))
                    held += len(got)
                keys.append(part.column(0))
                if held >= block_tokens:
                    yield from flush()
                    ids, keys, held = [], [], 0
        if ids:
            yield from flush()

    schema = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return source.mapInArrow(run, schema)
