"""Byte-level BPE: encoding whole texts by merge replay, and decoding.

Each batch of texts is one corpus. Its distinct pieces (matches of the split pattern) lie in one array of tokens with
links to their neighbours; an inverted index leads from the rank of a token pair to the places where the pair stands.
Ranks are taken from a heap in ascending order; all places of a rank are merged at once, and only the pairs with the
touched neighbours are looked up again and indexed. A place that stands twice in one piece waits for the next turn of
the same rank, so the order within each piece is that of lowest rank first, leftmost first. A pair newly made may have
a lower rank than its parts; it then comes next, as in piecewise merging. A piece of more than LONG bytes, such as a word
of a whole text, would take as many turns as it has places of a rank; it is replayed by itself, by a heap of (rank, place),
in time n log n.

The pattern is GPT-2's: contractions, runs of letters, of digits, of other characters, each with a space before it,
and white space. It is applied to whole columns by character classes.

Defined results: a null text is an empty text; an empty text has no tokens; texts of any length are encoded whole;
repeated rows give repeated results; an empty table gives an empty table; extra columns are not read, and carried by
encode() and decode(). Pieces are told apart by their bytes; hashes only find them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import U, equal_spans, slices, span_hashes, utf8

#: A corpus of the replay: so many bytes of whole texts. Pieces kept from earlier corpora of the same worker.
CORPUS_BYTES, KEPT_PIECES = 4 << 20, 1 << 19
#: Bytes of texts split or decoded at once, and of new pieces replayed at once: temporary arrays are up to 50 times as much.
#: A longer text or piece stands alone.
SPLIT_BYTES, REPLAY_BYTES = 1 << 18, 1 << 20
#: Pieces of more bytes are replayed by themselves; it moves cost only.
LONG = 512
NEVER = np.int32(2**31 - 1)
#: White_Space of Unicode.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES, LETTERS, DIGITS, OTHERS = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTERS, "N": DIGITS}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHERS) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACES
        _classes.append(table)
    return _classes[0]


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that lie one behind the other between bounds."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(point)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[point]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, bounds)] = True
    head[n] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run_end = start.copy()  # before white space is cut: ends of runs
    last = np.flatnonzero((kind == SPACES) & run_end[1:] & ~head[1:])  # last of white space before something
    start[last] = True
    start[last[point[last] == 32] + 1] = False
    # contractions: an apostrophe that begins a piece, before certain letters of the same text
    at = np.flatnonzero((point == 39) & start[:n])
    p1 = np.append(point, [0, 0, 0]).astype(np.int64)
    one = np.isin(p1[at + 1], [ord(c) for c in "stmd"]) & ~head[np.minimum(at + 1, n)]
    pair = p1[at + 1] * 0x110000 + p1[at + 2]
    two = np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & ~head[np.minimum(at + 1, n)] & ~head[np.minimum(at + 2, n)]
    for where, size in ((one, 2), (two & ~one, 3)):
        start[at[where] + 1] = False
        start[at[where] + size] = True
    return lead[start[:n]]


class Replay:
    """Ranks of one vocabulary, and the pieces encoded with them so far."""

    def __init__(self, ranks: bytes):
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = tokens
        size = max(tokens.values()) + 1
        made = {}
        for t, r in tokens.items():
            for k in range(1, len(t)):
                a, b = tokens.get(t[:k]), tokens.get(t[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = r
        self.made = made
        self.pair = np.array(sorted(made), np.int64)
        self.rank = np.array([made[x] for x in self.pair.tolist()] + [NEVER], np.int32)
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        by_id = [b""] * size
        for t, r in tokens.items():
            by_id[r] = t
        self.width = np.array([len(t) for t in by_id], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)  # sorted hashes of pieces, with the span of their ids
        self.lo = self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.at_text = self.size = np.zeros(0, np.int64)  # the bytes of known pieces
        self.text = np.zeros(0, np.uint8)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.rank[at], NEVER)

    def encode(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces that lie one behind the other (first: their first bytes and the end), and how many each has."""
        n = len(text)
        kind = np.int32 if n < NEVER else np.int64
        word = np.repeat(np.arange(len(first) - 1, dtype=kind), np.diff(first))
        token, alive = self.byte[text], np.ones(n, bool)
        after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        after[first[1:] - 1] = -1
        before[first[:-1]] = -1
        rank = np.full(n, NEVER, np.int32)
        inner = np.flatnonzero(after >= 0).astype(kind)
        rank[inner] = self.look(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            r = rank[places]
            places, r = places[r != NEVER], r[r != NEVER]
            if len(places) == 1:
                groups = [(int(r[0]), places)]
            else:
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
                groups = zip(r[np.concatenate([[0], cut])].tolist() if len(r) else [], np.split(places, cut))
            for k, at in groups:
                if k not in index:
                    index[k] = []
                    heapq.heappush(heap, k)
                index[k].append(at)

        whole = np.zeros(len(first) - 1, bool)  # pieces that are tokens themselves need no merge
        raw = text.tobytes()
        own = [self.tokens.get(raw[a:b], -1) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        own = np.array(own, np.int32)
        whole = own >= 0
        long = ~whole & (np.diff(first) > LONG)
        add(inner[~(whole | long)[word[inner]]])
        while heap:
            k = heapq.heappop(heap)
            at = index.pop(k)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[rank[at] == k]
            if len(at) > 1:
                at = np.sort(at)
                again = np.zeros(len(at), bool)
                again[1:] = word[at[1:]] == word[at[:-1]]
                if again.any():
                    index[k] = [at[again]]
                    heapq.heappush(heap, k)
                    at = at[~again]
            if not len(at):
                continue
            right = after[at]
            then = after[right]
            token[at] = k
            alive[right] = False
            rank[right] = NEVER
            after[at] = then
            has = then >= 0
            before[then[has]] = at[has]
            rank[at] = NEVER
            rank[at[has]] = self.look(token[at[has]], token[then[has]])
            left = before[at]
            met = left >= 0
            left = left[met]
            rank[left] = self.look(token[left], token[at[met]])
            touched = np.concatenate([at[has], left])
            if len(touched):
                add(touched)
        token[first[:-1][whole]] = own[whole]
        alive[np.flatnonzero(whole[word])] = False
        alive[first[:-1][whole]] = True
        for k in np.flatnonzero(long).tolist():
            a, b = int(first[k]), int(first[k + 1])
            ids = self.replay_one(raw[a:b])
            token[a : a + len(ids)] = ids
            alive[a:b] = np.arange(b - a) < len(ids)
        return token[alive], np.bincount(word[alive], minlength=len(first) - 1)

    def replay_one(self, piece: bytes) -> list[int]:
        """Tokens of one piece: lowest rank first, leftmost first."""
        made, n = self.made, len(piece)
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [made.get(a << 32 | b, -1) for a, b in zip(token, token[1:])] + [-1]
        heap = [r << 40 | p for p, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            r, p = x >> 40, x & ((1 << 40) - 1)
            if rank[p] != r:  # another merge has changed the pair that began here
                continue
            rank[after[p]] = -1
            token[p], after[p] = r, after[after[p]]
            s, left = after[p], before[p]
            rank[p] = -1
            if s < n:
                before[s] = p
                rank[p] = made.get(r << 32 | token[s], -1)
                if rank[p] >= 0:
                    heapq.heappush(heap, rank[p] << 40 | p)
            if left >= 0:
                rank[left] = made.get(token[left] << 32 | r, -1)
                if rank[left] >= 0:
                    heapq.heappush(heap, rank[left] << 40 | left)
        out, p = [], 0
        while p < n:
            out.append(token[p])
            p = after[p]
        return out

    def runs(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for runs of whole pieces of about REPLAY_BYTES, so that memory follows the run."""
        found = [self.encode(text[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in slices(first, REPLAY_BYTES, len(first))]
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def learn(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Encodes the pieces of a corpus (text, width and hash of each) whose hash is not known yet."""
        texts, widths, names = [], [], []
        for text, width, name in found:
            first = np.cumsum(width, dtype=np.int64) - width
            name, one = np.unique(name, return_index=True)
            new = ~np.isin(name, self.known, assume_unique=True)
            name, one = name[new], one[new]
            width = width[one].astype(np.int64)
            texts.append(text[np.repeat(first[one] - (np.cumsum(width) - width), width) + np.arange(width.sum())])
            widths.append(width)
            names.append(name)
        name, width, text = np.concatenate(names), np.concatenate(widths), np.concatenate(texts)
        at = np.cumsum(width) - width
        name, one = np.unique(name, return_index=True)
        if not len(name):
            return
        w = width[one]
        text = text[np.repeat(at[one] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
        ids, n = self.runs(text, np.concatenate([[0], np.cumsum(w)]))
        lo = np.cumsum(n) - n + len(self.ids)
        order = np.argsort(np.concatenate([self.known, name]), kind="stable")
        self.known = np.concatenate([self.known, name])[order]
        self.lo, self.n = np.concatenate([self.lo, lo])[order], np.concatenate([self.n, n])[order]
        self.ids = np.concatenate([self.ids, ids])
        self.at_text = np.concatenate([self.at_text, np.cumsum(w) - w + len(self.text)])[order]
        self.size = np.concatenate([self.size, w])[order]
        self.text = np.concatenate([self.text, text])

    def spans(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of pieces lie, how many they are, and the ids. A known piece of the same hash counts only if its
        bytes are those of the piece; pieces that share a hash by chance are encoded again, by themselves."""
        at = np.searchsorted(self.known, name)
        lo, n, ids = self.lo[at], self.n[at], self.ids
        same = self.size[at] == end - first
        fits = np.flatnonzero(same)
        same[fits] = equal_spans(text, first[fits], self.text, self.at_text[at[fits]], self.size[at[fits]])
        if not same.all():
            other = np.flatnonzero(~same)
            w = (end - first)[other]
            own = text[np.repeat(first[other] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
            more, k = self.runs(own, np.concatenate([[0], np.cumsum(w)]))
            lo[other], n[other] = np.cumsum(k) - k + len(ids), k
            ids = np.concatenate([ids, more])
        return lo, n, ids

    def corpus(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of documents i..j: their range, ids one behind the other, and number of ids of each document."""
        if len(self.known) > KEPT_PIECES:
            self.forget()
        cuts, found = [(i + a, i + b) for a, b in slices(offsets[i : j + 1], SPLIT_BYTES)], []
        for a, b in cuts:
            text, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            first = pieces(text, bounds)
            end = np.append(first[1:], len(text))[: len(first)]
            found.append((text, (end - first).astype(np.int32), span_hashes(text, first, end)))
        self.learn(found)
        for (a, b), (text, width, name) in zip(cuts, found):
            end = np.cumsum(width, dtype=np.int64)
            first = end - width
            lo, n, ids = self.spans(text, first, end, name) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64), self.ids)
            ids = ids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int32)
            total = np.concatenate([[0], np.cumsum(n)])
            cut = total[np.searchsorted(first, offsets[a : b + 1] - offsets[a])]
            yield a, b, ids, np.diff(cut)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the number of bytes of each."""
        width = self.width[ids]
        at = np.repeat(self.at[ids] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        return self.bytes[at], width


_replays: dict[str, Replay] = {}


def _replay(ranks: bytes) -> Replay:
    name = hashlib.sha256(ranks).hexdigest()
    if name not in _replays:
        _replays[name] = Replay(ranks)
    return _replays[name]


def _corpora(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return slices(offsets, CORPUS_BYTES)


def free(name: str, taken: list[str], other: str) -> str:
    """name, or other if a column has that name in any case, or other with as many underscores as it takes."""
    low = {c.lower() for c in taken}
    if name.lower() not in low:
        return name
    while other.lower() in low:
        other += "_"
    return other


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """All columns of docs and ids array<int> (named as free() says). The rank file is read where this is called and sent
    to the workers."""
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    name = free("ids", docs.columns, f"ids_of_{text}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(ranks.value)
        for batch in batches:
            data, offsets = utf8(batch[text])
            for i, j in _corpora(offsets):
                for a, b, ids, n in replay.corpus(data, offsets, i, j):
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """All columns of df and decoded binary (named as free() says): the bytes of the ids (null ids: null)."""
    name = free("decoded", df.columns, f"decoded_{ids}")
    ranks = df.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(ranks.value)
        for batch in batches:
            out = [None if x is None else replay.decode(np.array(x, np.int64))[0].tobytes() for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(of, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (the ids' bytes)."""
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(ranks.value)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in _corpora(offsets):
                for a, b, ids, n in replay.corpus(data, offsets, i, j):
                    decoded, width = replay.decode(ids)
                    id_cut = np.concatenate([[0], np.cumsum(n)])
                    byte_cut = np.concatenate([[0], np.cumsum(width)])[id_cut]
                    raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes())
                    cuts = zip(id_cut[:-1].tolist(), id_cut[1:].tolist(), byte_cut[:-1].tolist(), byte_cut[1:].tolist())
                    sha = [(hashlib.sha256(raw[4 * p : 4 * q]).hexdigest(), hashlib.sha256(text[r:s]).hexdigest()) for p, q, r, s in cuts]
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(a, b - a), pa.array(n.astype(np.int64)), pa.array([x for x, _ in sha], pa.string()), pa.array([y for _, y in sha], pa.string())],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
