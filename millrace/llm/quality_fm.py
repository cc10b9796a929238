"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_j x_j + sum over pairs <v_j, v_k> x_j x_k). The pairs are summed in time linear in the
features by the sum-of-squares identity: half of |sum v_j x_j|^2 - sum |v_j|^2 x_j^2. Word features are square roots of
the shares of hashed lower-case words; statistics are standardised with the mean and deviation of the sample.

Fitted on at most SAMPLE labelled rows (a documented bound: those of smallest hash of doc_id), by Adam on the driver; a
row is its hashed features, at most 2**BITS numbers, never its text. Scoring reads whole texts.

Defined results: null and empty texts are scored on zero words; rows whose labels disagree are not learnt from; with no
usable label, or one class alone, every score is that share; copies get equal scores; empty tables give empty tables;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import LOWER, U, Words, slices, sums, utf8
from .quality_rules import SYMBOLS, repeated

BITS, FACTORS = 14, 8
SAMPLE, EPOCHS, RATE, DECAY, SEED = 6000, 12, 0.02, 1e-5, 7
STATISTICS = ("log_words", "log_bytes", "word_length", "symbols", "upper", "digits", "punctuation", "not_ascii", "lines", "repeated", "distinct", "longest", "log_n_chars")


def features(data: np.ndarray, offsets: np.ndarray, i: int, j: int, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, first of each document and the end, documents x statistics)."""
    w = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], 0, j - i)
    h = w.hashes()
    bucket = (h >> U(64 - BITS)).astype(np.int64)
    key, count = np.unique(w.doc << BITS | bucket, return_counts=True)
    doc = key >> BITS
    first = np.searchsorted(doc, np.arange(w.docs + 1))
    value = np.sqrt(count / np.maximum(w.counts, 1)[doc])
    raw, n = data[offsets[i] : offsets[j]], np.maximum(w.counts, 1)
    size = np.maximum(np.diff(w.bounds), 1)
    of = lambda table: sums(table[raw], w.bounds) / size
    tables = {name: np.zeros(256, bool) for name in ("symbols", "upper", "digits", "punctuation", "not_ascii", "line")}
    tables["symbols"][list(SYMBOLS)] = True
    tables["upper"][65:91] = True
    tables["digits"][48:58] = True
    tables["punctuation"][list(b"!?.,;:\"'()-")] = True
    tables["not_ascii"][128:] = True
    tables["line"][10] = True
    length = (w.ends - w.starts).astype(np.float64)
    longest = np.zeros(w.docs)
    np.maximum.at(longest, w.doc, length)
    stats = np.stack(
        [
            np.log1p(w.counts), np.log1p(np.diff(w.bounds)), sums(length, w.first) / n, of(tables["symbols"]), of(tables["upper"]), of(tables["digits"]), of(tables["punctuation"]),
            of(tables["not_ascii"]), of(tables["line"]), sums(repeated(w, h, 5), w.first) / n, np.diff(first) / n, np.log1p(longest), np.log1p(np.maximum(n_chars[i:j], 0)),
        ],
        axis=1,
    )
    return key & ((1 << BITS) - 1), value, first, stats


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray  # the same x FACTORS
    mean: np.ndarray
    deviation: np.ndarray

    def join(self, bucket, value, first, stats):
        """Sparse rows with the standardised statistics behind the words."""
        z = np.clip((stats - self.mean) / self.deviation, -5, 5) / np.sqrt(stats.shape[1])
        n, k = np.diff(first), stats.shape[1]
        row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), k)])
        col = np.concatenate([bucket, np.tile(np.arange(k) + (1 << BITS), len(n))])
        x = np.concatenate([value, z.ravel()])
        order = np.argsort(row, kind="stable")
        return col[order], x[order], np.concatenate([[0], np.cumsum(n + k)])

    def margins(self, col, x, first) -> np.ndarray:
        linear = sums(self.linear[col] * x, first)
        pairs = np.zeros(len(first) - 1)
        for f in range(self.factors.shape[1]):
            vx = self.factors[col, f] * x
            pairs += sums(vx, first) ** 2 - sums(vx * vx, first)
        return self.bias + linear + 0.5 * pairs


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Machine:
    """rows: buckets, values, statistics, label."""
    k = len(STATISTICS)
    stats = np.array([r[2] for r in rows]).reshape(-1, k)
    label = np.array([r[3] for r in rows], np.float64)
    share = float(label.mean()) if len(label) else 0.5
    size = (1 << BITS) + k
    rng = np.random.default_rng(SEED)
    mean = stats.mean(0) if len(rows) else np.zeros(k)
    deviation = np.maximum(stats.std(0), 1e-6) if len(rows) else np.ones(k)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    m = Machine(bias, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), mean, deviation)
    if not len(rows) or share in (0.0, 1.0):
        m.factors[:] = 0
        return m
    first = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    col, x, first = m.join(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), first, stats)
    theta = np.concatenate([m.linear[:, None], m.factors], 1)
    one, two, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            n = first[part + 1] - first[part]
            cut = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(first[part] - cut[:-1], n) + np.arange(cut[-1])
            c, v = col[at], x[at]
            m.linear, m.factors = theta[:, 0], theta[:, 1:]
            p = 1 / (1 + np.exp(-m.margins(c, v, cut)))
            g = np.repeat((p - label[part]) / len(part), n)
            m.bias -= RATE * float((p - label[part]).mean())
            vx = m.factors[c] * v[:, None]
            total = np.repeat(np.stack([sums(vx[:, f], cut) for f in range(FACTORS)], 1), n, axis=0)
            grad_at = np.concatenate([(g * v)[:, None], (g * v)[:, None] * (total - vx)], 1)
            used, slot = np.unique(c, return_inverse=True)
            grad = np.stack([np.bincount(slot, grad_at[:, f], minlength=len(used)) for f in range(FACTORS + 1)], 1) + DECAY * theta[used]
            step += 1
            one[used] = 0.9 * one[used] + 0.1 * grad
            two[used] = 0.999 * two[used] + 0.001 * grad * grad
            theta[used] -= RATE * (one[used] / (1 - 0.9**step)) / (np.sqrt(two[used] / (1 - 0.999**step)) + 1e-8)
    m.linear, m.factors = np.ascontiguousarray(theta[:, 0]), np.ascontiguousarray(theta[:, 1:])
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """docs: doc_id, text, n_chars. labels: doc_id and a label of 0 or 1."""
    sure = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    chosen = sure.orderBy(F.xxhash64(F.lit("fm"), "doc_id"), "doc_id").limit(sample).select("doc_id", F.col("y").cast("int").alias("y"))
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most sample rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            n_chars = np.nan_to_num(batch["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False))
            for i, j in slices(offsets):
                bucket, value, first, stats = features(data, offsets, i, j, n_chars)
                cuts = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value)),
                        pa.array(stats.tolist(), pa.list_(pa.float64())), batch["y"].slice(i, j - i),
                    ],
                    names=["doc_id", "bucket", "value", "stats", "y"],
                )

    found = rows.select("doc_id", "text", "n_chars", "y").mapInArrow(of, "doc_id long, bucket array<int>, value array<double>, stats array<double>, y int").toArrow()
    order = np.argsort(np.asarray(found["doc_id"]), kind="stable")
    cols = [found[c].combine_chunks() for c in ("bucket", "value", "stats", "y")]
    return fit([tuple(np.asarray(c[int(k)].values if c is not cols[3] else c[int(k)].as_py()) for c in cols) for k in order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted. docs: doc_id, text, n_chars."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = utf8(batch["text"])
            n_chars = np.nan_to_num(batch["n_chars"].cast(pa.float64()).to_numpy(zero_copy_only=False))
            for i, j in slices(offsets):
                p = 1 / (1 + np.exp(-np.clip(m.margins(*m.join(*features(data, offsets, i, j, n_chars))), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(of, "doc_id long, score double, predicted int")
