"""Vectorised text primitives shared by the corpus operators.

Every function works on a whole Arrow batch of UTF-8 text at once: the bytes of
all documents lie in one ``uint8`` buffer, and words are runs of bytes other than
``0x20`` and ``0x09``-``0x0D``.

A word of up to eight bytes has its own number, so two such words never share a
hash; a longer one has the 64-bit BLAKE2b digest of its bytes, computed once for the
distinct long words of a slice (told apart by their bytes, not by a weaker hash).
:meth:`Words.codes` numbers the words of a slice exactly, for operators that confirm
by comparison what hashes proposed.

Empty and null texts have no words.  Texts of any length are handled whole; a
batch is cut into slices of about ``SLICE_BYTES`` between documents (a longer
document is a slice of its own), which bounds the memory of the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_word = (~_space).astype(np.uint8)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_CLOSE = np.array([0xFF << 8 * n if n < 8 else 0 for n in range(9)], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """p**i and p**-i modulo 2**64, grown on demand."""

    def __init__(self, prime: np.uint64) -> None:
        self.prime = prime
        inverse = pow(int(prime), -1, 1 << 64)
        self.inverse = np.uint64(inverse)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            step_up = self.up[-1:] * self.prime
            step_down = self.down[-1:] * self.inverse
            self.up = np.concatenate([self.up, self.up * step_up])
            self.down = np.concatenate([self.down, self.down * step_down])
            assert len(self.up) == 2 * size
        return self.up, self.down


_powers: dict[int, _Powers] = {}


def _power(seed: int) -> _Powers:
    if seed not in _powers:
        _powers[seed] = _Powers(_PRIME + np.uint64(2 * seed * 0x1234567))
    return _powers[seed]


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # zero chunks
        col = pa.array([], pa.string())
    col = col.cast(pa.large_binary() if pa.types.is_large_binary(col.type) or pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges [a, b) of about `limit` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of a slice of documents.

    ``start``/``end`` are byte positions in ``data``; ``first`` has n+1 word
    positions, so document i owns words ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = _word) -> None:
        """classes: a class for each byte; a word is a run of one class, and class 0 separates."""
        self.data, self.offsets = data, offsets
        n = len(data)
        if n:
            kind = classes[data]
            edge = np.empty(n + 1, bool)
            edge[0] = edge[n] = True
            np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
            edge[offsets] = True
            inside = kind != 0
            self.start = np.flatnonzero(edge[:-1] & inside)
            self.end = np.flatnonzero(edge[1:] & inside) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self._bytes: dict[bool, np.ndarray] = {}
        self._known: dict[tuple[bool, int | None], np.ndarray] = {}

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def _folded(self, lower: bool) -> np.ndarray:
        """The bytes, in lower case if asked, with eight spare bytes behind them."""
        if lower not in self._bytes:
            self._bytes[lower] = np.concatenate([_lower[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        return self._bytes[lower]

    def _pieces(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place as a number; a byte that no text holds closes shorter ones."""
        eight = np.lib.stride_tricks.as_strided(data[: len(data) // 8 * 8].view("<u8"), (len(data) - 7,), (1,))[at]
        short = np.minimum(size, 8).astype(np.int64)
        return (eight & _KEEP[short]) | _CLOSE[short]

    def hashes(self, lower: bool = False, leading: int | None = None) -> np.ndarray:
        """A hash of each word, or of its `leading` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if (lower, leading) in self._known:
            return self._known[lower, leading]
        data = self._folded(lower)
        size = self.end - self.start if leading is None else np.minimum(self.end - self.start, leading)
        out = mix64(self._pieces(data, self.start, size))
        long = np.flatnonzero(size > 8)
        if len(long):
            index, first = self._equal(data, self.start[long], size[long])
            raw = data.tobytes()
            digests = b"".join(blake2b(raw[a : a + n], digest_size=8).digest() for a, n in zip(self.start[long][first].tolist(), size[long][first].tolist(), strict=True))
            out[long] = np.frombuffer(digests, np.uint64)[index]
        self._known[lower, leading] = out
        return out

    def _equal(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of equal byte runs of more than eight bytes: each one's class, and a member of each class."""
        weak = self._pieces(data, start, size) ^ mix64(self._pieces(data, start + size - 8, size) + size.astype(np.uint64))
        step, left = 8, np.flatnonzero(size > 16)
        while len(left) and step < _LONG:
            weak[left] = mix64(weak[left] ^ self._pieces(data, start[left] + step, size[left]))
            step += 8
            left = left[size[left] > step + 8]
        _, first, index = np.unique(weak, return_index=True, return_inverse=True)
        rep = first[index]
        same = size == size[rep]
        # piece by piece; the last one overlaps the one before it
        left, step = np.flatnonzero(same & (rep != np.arange(len(rep)))), 0
        while len(left) and step < _LONG:
            shift = np.minimum(step, size[left] - 8)
            equal = self._pieces(data, start[left] + shift, size[left]) == self._pieces(data, start[rep[left]] + shift, size[left])
            same[left[~equal]] = False
            step += 8
            left = left[equal & (step < size[left])]
        for i in left.tolist():
            same[i] = np.array_equal(data[start[i] : start[i] + size[i]], data[start[rep[i]] : start[rep[i]] + size[i]])
        odd = np.flatnonzero(~same)
        if len(odd):  # unlike words under one weak hash: by their bytes
            raw, names, firsts = data.tobytes(), {}, first.tolist()
            for i in first.tolist():
                names[raw[start[i] : start[i] + size[i]]] = len(names)
            for i in odd.tolist():
                word = raw[start[i] : start[i] + size[i]]
                if word not in names:
                    names[word] = len(firsts)
                    firsts.append(i)
                index[i] = names[word]
            first = np.array(firsts)
        return index, first

    def codes(self, lower: bool = False) -> np.ndarray:
        """A number below the count of distinct words for each word; equal only for equal words."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        data = self._folded(lower)
        size = self.end - self.start
        short = size <= 8
        out = np.zeros(len(size), np.int64)
        base = 0
        if short.any():
            names, out[short] = np.unique(self._pieces(data, self.start[short], size[short]), return_inverse=True)
            base = len(names)
        if not short.all():
            out[~short] = base + self._equal(data, self.start[~short], size[~short])[0]
        return out


def word_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(a, b, Words of documents a..b) over a string column."""
    data, offsets = text_buffer(col)
    for a, b in slices(offsets, limit):
        part = offsets[a : b + 1]
        yield a, b, Words(data[part[0] : part[-1]], part - part[0])


def gram_hashes(word_hash: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of each k consecutive words (n-k+1 values).

    Spans may cross documents; callers mask those with :func:`gram_valid`.
    """
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(seed).upto(len(word_hash) + 1)
    prefix = np.empty(len(word_hash) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(word_hash * up[: len(word_hash)], out=prefix[1:])
    return mix64((prefix[k:] - prefix[:-k]) * down[:n])


def gram_valid(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """True where a k-word span stays inside one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= ends[:n]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling (log2(width) passes)."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def offsets_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out
