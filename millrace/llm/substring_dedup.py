"""Substring dedup: words of passages of 50 or more words that a document of smaller doc_id also holds.

A difference cover of the residues modulo 31 has, for any two places in two documents, a step below 31 after which both
are at cover places. So two equal windows of 50 words share an anchor, 20 words that start at cover places of both
documents, and it is enough to hash the anchors: 6 places of 31. Documents that share an anchor with another document
are extended: the words of the windows around their shared anchors are digested (BLAKE2b, 128 bits), and a window goes if
a document of smaller doc_id has one of the same digest. 64-bit hashes find anchors only, and never decide.

Both groupings first work within a block (an Arrow batch): what documents of one block share is settled there, and one
row a block and hash goes on. A hash that a third of all documents hold is thus as many rows as there are blocks.

Defined results: a null or empty text has 0 words and the digest of nothing; texts of fewer than 50 words stay; repeated
passages within one document stay; rows of equal doc_id are one document's and never shorten each other; a row without a
doc_id stays whole and shortens nothing; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import only_ids, written
from ._words import U, Words, firsts, mix, slices, utf8, windows

WINDOW = 50
#: A perfect difference cover; every residue modulo 31 is a difference of two of its six places.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
PLACE = 1 << 32


def _anchors(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in documents long enough for a window, and their hashes."""
    at = w.valid(ANCHOR)
    at = at[w.counts[w.doc[at]] >= WINDOW]
    at = at[np.isin(w.position(at) % PERIOD, COVER)]
    return at, windows(h, at, ANCHOR)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids = np.asarray(batch["doc_id"])
        hs, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j)
            at, x = _anchors(w, w.hashes())
            hs.append(x)
            docs.append(ids[i + w.doc[at]])
        h, doc = np.concatenate(hs), np.concatenate(docs)
        order, lead, more = firsts(h, doc)
        h, doc = h[order], doc[order]
        key = np.where(lead, h, mix(h ^ doc.astype(U)))  # what is known already is dealt out evenly
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(doc), pa.array(~lead | more)], names=["key", "h", "doc_id", "known"])


def _marked_windows(w: Words, h: np.ndarray, hot: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of windows around anchors whose (document, hash) is among (owner, hot)."""
    at, x = _anchors(w, h)
    # (document, hash) pairs as one value; a chance equality only marks a window more
    mine, marked = mix(x ^ mix(w.doc[at].astype(U))), mix(hot ^ mix(owner.astype(U)))
    at = at[np.isin(mine, marked)]
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, np.maximum(at - (PERIOD - 1), w.first[w.doc[at]]), 1)
    np.add.at(cover, at + 1, -1)
    full = w.valid(WINDOW)
    return full[np.cumsum(cover)[full] > 0]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.values), np.asarray(column.offsets)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids = np.asarray(batch["doc_id"])
        hot, cut = _lists(batch["hot"])
        cols: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j)
            at = _marked_windows(w, w.hashes(), hot[cut[i] : cut[j]].view(U), np.repeat(np.arange(j - i), np.diff(cut[i : j + 1])))
            name = w.digests(at, WINDOW)
            for c, x in zip(cols, (name[:, 0], name[:, 1], ids[i + w.doc[at]], w.position(at))):
                c.append(x)
        h, g, doc, place = (np.concatenate(c) for c in cols)
        order, lead, _ = firsts(h, doc, g)
        h, g, doc, place = h[order], g[order], doc[order], place[order]
        # a document of the block with a smaller id has it: known, as runs of places
        d, p = doc[~lead], place[~lead]
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(d)))
        h, g, doc, place = h[lead], g[lead], doc[lead], place[lead]
        known = mix(d[at].astype(U) ^ mix(p[at].astype(U)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([h, known]).view(np.int64)),
                pa.array(np.concatenate([g, known]).view(np.int64)),
                pa.array(np.concatenate([doc, d[at]])),
                pa.array(np.concatenate([place * PLACE + 1, p[at] * PLACE + run])),
                pa.array(np.concatenate([np.zeros(len(h), bool), np.ones(len(at), bool)])),
            ],
            names=["h", "g", "doc_id", "run", "known"],
        )


def _elsewhere(w: Words, gone: np.ndarray) -> np.ndarray:
    """Places of the windows at gone, and of the same windows elsewhere in the same document."""
    at = w.valid(WINDOW)
    name = mix(windows(w.hashes(), at, WINDOW) ^ mix(w.doc[at].astype(U)))
    is_gone = np.isin(at, gone)
    like = at[np.isin(name, name[is_gone]) & ~is_gone]
    if not len(like):
        return gone
    same = {(d, *x) for d, x in zip(w.doc[gone].tolist(), map(tuple, w.digests(gone, WINDOW).tolist()))}
    also = [p for p, d, x in zip(like.tolist(), w.doc[like].tolist(), map(tuple, w.digests(like, WINDOW).tolist())) if (d, *x) in same]
    return np.concatenate([gone, np.array(also, gone.dtype)])


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        runs, cut = _lists(batch["runs"])
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j)
            place, length = np.divmod(runs[cut[i] : cut[j]], PLACE)
            owner = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
            fits = place + length + WINDOW - 1 <= w.counts[owner]  # else the runs are of another row of this doc_id
            place, length, owner = place[fits], length[fits], owner[fits]
            start = w.first[owner] + place
            first = np.zeros(len(w) + 1, np.int64)
            np.add.at(first, start, 1)
            np.add.at(first, start + length, -1)
            gone = np.flatnonzero(np.cumsum(first) > 0)
            if len(gone):
                gone = _elsewhere(w, gone)
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            keep = np.cumsum(cover)[: len(w)] == 0
            raw, out, left = w.data.tobytes(), [], []
            bounds, firsts = w.bounds.tolist(), w.first.tolist()
            total = np.concatenate([[0], np.cumsum(keep)])[w.first]
            for k in range(j - i):
                words = raw[bounds[k] : bounds[k + 1]].split()
                if total[k + 1] - total[k] < len(words):
                    words = compress(words, keep[firsts[k] : firsts[k + 1]].tolist())
                text = b" ".join(words)
                left.append(text)
                out.append(hashlib.sha256(text).hexdigest())
            cols = [batch["doc_id"].slice(i, j - i), pa.array(w.counts.astype(np.int64)), pa.array(w.counts - np.diff(total)), pa.array(out, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left, pa.binary()).cast(pa.string())] if texts else cols, names=[*names, "kept_text"] if texts else names)


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with texts also kept_text, the kept words joined by one space."""
    docs = docs.select("doc_id", "text")
    rows = docs.where("doc_id is not null").mapInArrow(_anchor_rows, "key long, h long, doc_id long, known boolean")
    w = Window.partitionBy("key")
    rows = rows.withColumns({"lo": F.min("doc_id").over(w), "hi": F.max("doc_id").over(w), "any": F.max("known").over(w)})
    # the anchors of a document: bounded by its length
    hot = written(rows.where("lo < hi or any").groupBy("doc_id").agg(F.collect_list("h").alias("hot")), "anchors")
    near = only_ids(docs, hot.select("doc_id")).join(hot.hint("merge"), "doc_id")
    found = near.mapInArrow(_window_rows, "h long, g long, doc_id long, run long, known boolean")
    found = found.withColumn("lo", F.min("doc_id").over(Window.partitionBy("h", "g"))).where("known or doc_id > lo")
    gone = written(found.groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "gone")
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _kept(batches, texts)

    ids = gone.select("doc_id")
    cut = only_ids(docs, ids).join(gone.hint("merge"), "doc_id").select("doc_id", "text", "runs")
    rest = only_ids(docs, ids, how="left_anti").withColumn("runs", F.array().cast("array<long>"))
    return cut.mapInArrow(kept, shape).union(rest.mapInArrow(kept, shape))
