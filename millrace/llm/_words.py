"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r). Everything works on whole
columns with numpy, a slice of a few MB at a time, so that memory follows the slice and not the batch.

Two kinds of names are made. 64-bit hashes only propose: they chain blocks of 8 bytes, and then words, through a bijective
mixer, so that no structure of the text makes them equal, but equal hashes are never taken for equal words. What decides a
result is compared byte by byte, or by BLAKE2b digests of 128 bits of the words themselves. Constants come from a fixed
seed, so every executor and every rerun computes the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_SEEDS = _RNG.integers(0, 2**63, 4, dtype=np.int64).astype(U)
_ODD = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Temporary arrays are up to 16 times a slice.
SLICE_BYTES = (1 << 20) - 1
#: Spans up to so many bytes are hashed block by block in numpy, longer ones one by one.
BLOCKS = 4
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the public splitmix64 finisher)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(_SEEDS[which] ^ size.astype(U))
    todo = np.flatnonzero(size <= 8 * BLOCKS)
    for k in range(BLOCKS):
        todo = todo[size[todo] > 8 * k]
        h[todo] = mix(h[todo] ^ (block[starts[todo] + 8 * k] & _MASK[np.minimum(size[todo] - 8 * k, 8)])) + _ODD
    long = np.flatnonzero(size > 8 * BLOCKS)
    if len(long):
        spans = zip(starts[long].tolist(), ends[long].tolist())
        found = b"".join([hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest() for a, b in spans])
        h[long] = mix(h[long] ^ np.frombuffer(found, "<u8"))
    return h


def equal_spans(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of x and of y, of the sizes given, hold the same bytes. Spans lie within x and y."""
    blocks = []
    for data in (x, y):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        blocks.append(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))
    out = np.ones(len(size), bool)
    todo = np.flatnonzero(size <= 8 * BLOCKS)
    for k in range(BLOCKS):
        todo = todo[size[todo] > 8 * k]
        differ = (blocks[0][xs[todo] + 8 * k] ^ blocks[1][ys[todo] + 8 * k]) & _MASK[np.minimum(size[todo] - 8 * k, 8)]
        out[todo] &= differ == 0
    for k in np.flatnonzero(size > 8 * BLOCKS).tolist():
        n = size[k]
        out[k] = np.array_equal(x[xs[k] : xs[k] + n], y[ys[k] : ys[k] + n])
    return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs of whole documents, at most so many, of about limit bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1), i + most, n)
        yield i, j
        i = j


class Words:
    """Words of documents i..j of a column: byte spans (relative to data) and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.data = LOWER[data[lo:hi]] if lower else data[lo:hi]
        self.bounds = offsets[i : j + 1] - lo
        self.docs = j - i
        n = hi - lo
        word = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds)  # first word of each document, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)

    def joined(self) -> bytes:
        """All words joined by one space; _from is where each begins."""
        if not hasattr(self, "_joined"):
            raw, cut = self.data.tobytes(), self.bounds.tolist()
            self._joined = b" ".join([w for a, b in zip(cut, cut[1:]) for w in raw[a:b].split()])
            self._from = np.cumsum(self.ends - self.starts + 1) - (self.ends - self.starts + 1)
        return self._joined

    def sequences(self) -> np.ndarray:
        """128-bit digests (two columns) of the word sequences of all documents."""
        raw, cut = self.data.tobytes(), self.bounds.tolist()
        return np.frombuffer(b"".join([hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(cut, cut[1:])]), "<u8").reshape(-1, 2)

    def digests(self, at: np.ndarray, width: int) -> np.ndarray:
        """128-bit digests (two columns) of the windows of so many words that start at the places at, whatever white space
        lies between the words. Words of one document each."""
        if not len(at):
            return np.zeros((0, 2), U)
        text, last = self.joined(), at + width - 1
        spans = zip(self._from[at].tolist(), (self._from[last] + self.ends[last] - self.starts[last]).tolist())
        return np.frombuffer(b"".join([hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in spans]), "<u8").reshape(-1, 2)

    def valid(self, width: int) -> np.ndarray:
        """Positions of words at which a window of so many words of one document starts."""
        if len(self) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self) - width + 1] == self.doc[width - 1 :])

    def position(self, at: np.ndarray) -> np.ndarray:
        """Place of words in their documents, from 0."""
        return at - self.first[self.doc[at]]


def windows(h: np.ndarray, at: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """64-bit hashes of the windows of so many words that start at the places at: pairs of words, pairs of pairs and so
    on are hashed once for all windows, and a window is chained from the runs of 1, 2, 4 .. words that make it up."""
    out = np.full(len(at), _SEEDS[which] ^ U(width))
    if not len(at):
        return out
    run, size, done = h, 1, 0
    while True:
        if width & size:
            out = mix(out ^ run[at + done]) + _ODD
            done += size
        if 2 * size > width:
            return out
        run = mix(run[:-size] * _ODD + run[size:])
        size *= 2


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over runs given by their first places and the end; empty runs sum to 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def firsts(h: np.ndarray, doc: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, g, doc) of the first row of each; whether it is the first of its (h, g); whether that has more documents.
    g: the other half of the name, if it has two."""
    order = np.lexsort((doc, h) if g is None else (doc, g, h))
    h, doc, g = h[order], doc[order], None if g is None else g[order]
    other = h[1:] != h[:-1] if g is None else (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    new, lead = np.ones(len(h), bool), np.ones(len(h), bool)
    new[1:] = other | (doc[1:] != doc[:-1])
    lead[1:] = other
    order, lead = order[new], lead[new]
    more = np.zeros(len(order), bool)
    more[:-1] = ~lead[1:]
    return order, lead, more
