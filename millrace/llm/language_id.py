"""Language ID of mixed texts: script ranges narrow the candidates, Viterbi labels the words.

Each language has, from all its labelled texts, the frequencies of hashed byte trigrams of lower-cased words, ends
marked. A word's score for a language is the sum of the log frequencies of its trigrams; languages that hardly ever use
the word's script are out. The Viterbi path over a text maximises scores less a penalty for each switch, so short
accidents do not break a span; runs of equal labels are the spans. The text's language is that of most letters.

The path is found in lockstep over all texts of a slice of a batch, slices being smaller the more languages there are. A text
longer than CHUNK words is cut into chunks, which are solved once for each entry label and then chained (of more than
MANY languages each text is one lane instead), so the steps of a slice are bounded and the path is still exact. A text
longer than a slice is solved slice by slice: forwards for the scores at their borders, backwards for the labels. Memory
follows the slice, whatever the batch, the text or the number of languages.

Defined results: null texts and texts without a letter are `und` with score 0 and no span; words without letters go with
their neighbours; ties go to the first language by name; copies get equal results; with no labelled text all are `und`;
empty tables give empty tables; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import U, Words, mix, slices

BITS = 16
SWITCH = 10.0
CHUNK = 2048
#: Of more languages, chunks are not solved for each entry label.
MANY = 16
#: Bytes of a slice times languages, and least and most bytes of a slice.
SLICE_WORK, SLICE_LEAST, SLICE_MOST = 16 << 20, 1 << 16, 4 << 20
#: A language may be a candidate for a script that at least this share of its words use.
SCRIPT_SHARE = 0.002
OUT = -60.0
#: First code points of script ranges in order; what lies between two belongs to the former.
SCRIPTS = [
    (0x0, "common"), (0x41, "latin"), (0x250, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x900, "devanagari"),
    (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"),
    (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
_NAMES = sorted({n for _, n in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
COMMON = _NAMES.index("common")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


class Text:
    """Lower-cased texts of some rows: words, hashed trigrams and the script of each word."""

    def __init__(self, texts: list[str]):
        low = [x.lower().encode("utf-8", "replace") for x in texts]
        data = np.frombuffer(b" " + b" ".join(low) + b" ", np.uint8).copy()
        ends = np.cumsum([1, *[len(x) + 1 for x in low]])
        self.w = w = Words(data, ends.astype(np.int64), 0, len(low))
        first = int(ends[0])
        body = data
        body[(body >= 9) & (body <= 13)] = 32
        b = body.astype(np.uint32)
        gram = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(U)
        self.bucket = (mix(gram) >> U(64 - BITS)).astype(np.int32)
        self.bucket[body[1:-1] == 32] = 1 << BITS  # a gram of two words: weight 0
        self.lo, self.hi = w.starts + first - 1, w.ends + first - 1  # grams of a word
        point = np.zeros(len(body), np.int64)
        point[(body >= 97) & (body < 123)] = 97
        for lead, count, bits in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
            at = np.flatnonzero((body >= lead) & (body < lead + (0x20 >> (count - 1))))
            at = at[at + count < len(body)]
            value = body[at].astype(np.int64) & bits
            for k in range(1, count + 1):
                value = value << 6 | body[at + k] & 0x3F
            point[at] = value
        script = _SCRIPT[np.searchsorted(_FROM, point, "right") - 1]
        script[(point < 0x41) | ((point >= 0x80) & (point < 0xC0))] = COMMON
        rank = np.where(script == COMMON, 0, script + 1)
        self.script = np.full(len(w), COMMON)
        if len(w):
            top = np.maximum.reduceat(rank, (w.starts + first))  # up to the next word: only white space follows
            self.script = np.where(top == 0, COMMON, top - 1)
        self.letters = np.diff(np.concatenate([[0], np.cumsum(rank > 0)])[np.stack([w.starts + first, w.ends + first])], axis=0)[0] if len(w) else np.zeros(0, np.int64)


def _blocks(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch["text"].to_pylist()
    size = np.cumsum([0, *[len(x or "") for x in texts]])
    for i, j in slices(size, limit):
        yield i, j, [x or "" for x in texts[i:j]]


def parts(text: str, limit: int) -> Iterator[str]:
    """A text cut at white space into parts of about limit characters; a longer word stands whole."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(c, at, at + limit) for c in " \t\n\x0b\x0c\r")
        if cut <= at:
            later = [k for k in (text.find(c, at + limit) for c in " \t\n\x0b\x0c\r") if k >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # langs x (buckets + 1), float32
    allowed: np.ndarray  # langs x scripts


def train(docs: DataFrame) -> Model:
    """From text and lang of all rows given: counts are summed on the cluster, a row a language and slot comes back
    (languages x (65,536 + scripts) at most)."""
    slots = (1 << BITS) + len(_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for texts, of in ((p, o) for i, j, x in _blocks(batch) for p, o in ([(x, langs[i:j])] if j - i > 1 else [([y], langs[i:j]) for y in parts(x[0], 1 << 20)])):
                t = Text(texts)
                name, code = np.unique(np.array(of, object).astype(str), return_inverse=True)
                word_lang = code[t.w.doc]
                n = t.hi - t.lo
                gram = np.repeat(t.lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                gram_lang = np.repeat(word_lang, n)
                for k, lang in enumerate(name.tolist()):
                    if lang not in found:
                        found[lang] = np.zeros(slots, np.int64)
                    found[lang][: 1 << BITS] += np.bincount(t.bucket[gram[gram_lang == k]], minlength=(1 << BITS) + 1)[: 1 << BITS]
                    found[lang][1 << BITS :] += np.bincount(t.script[word_lang == k], minlength=len(_NAMES))
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "slot", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, slot long, n long")
    sums = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    full = np.zeros((len(langs), slots))
    if langs:
        code = np.searchsorted(np.array(langs), np.array(sums["lang"].to_pylist()))
        full[code, np.asarray(sums["slot"])] = np.asarray(sums["n"])
    grams, scripts = full[:, : 1 << BITS], full[:, 1 << BITS :]
    score = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS)))
    table = np.zeros((len(langs), (1 << BITS) + 1), np.float32)
    table[:, :-1] = score
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed[:, COMMON] = True
    return Model(langs, table, allowed)


def emissions(t: Text, m: Model) -> np.ndarray:
    """Words x languages: scores below the best of the word; 0 for words without letters."""
    out = np.empty((len(t.w), len(m.langs)), np.float32)
    for k in range(len(m.langs)):
        run = np.concatenate([[0.0], np.cumsum(m.table[k][t.bucket], dtype=np.float64)])
        out[:, k] = run[t.hi] - run[t.lo]
    fits = m.allowed[:, t.script].T
    fits |= ~fits.any(1, keepdims=True)  # a script no language uses narrows nothing
    out[~fits] = -np.inf
    out -= out.max(1, keepdims=True)
    np.maximum(out, OUT, out=out)
    out[t.letters == 0] = 0
    return out


def _lockstep(e: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, penalty: float):
    """Viterbi over lanes, each a run of words of e with scores to start from. Gives final scores and a function that
    labels all lanes for given final labels, and tells the labels before their first words."""
    lanes, langs = start.shape
    order = np.argsort(-length, kind="stable")
    v = start[order].copy()
    f, n = first[order], length[order]
    steps = int(n[0]) if lanes else 0
    active = np.searchsorted(-n, -np.arange(steps), "left")  # lanes longer than each step
    base = np.concatenate([[0], np.cumsum(n)])[:-1]
    stay = np.zeros((int(n.sum()), langs), bool)
    kind = np.min_scalar_type(max(langs - 1, 0))  # holds every label
    best = np.zeros(int(n.sum()), kind)
    for t in range(steps):
        a = active[t]
        x = v[:a]
        top = x.argmax(1)
        leap = x[np.arange(a), top] - penalty
        same = x >= leap[:, None]
        at = base[:a] + t
        stay[at], best[at] = same, top
        v[:a] = np.where(same, x, leap[:, None]) + e[f[:a] + t]

    def label(last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in e, labels) of the words of all lanes, and the labels before."""
        state = last[order].astype(np.int64)
        out = np.zeros(len(best), kind)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            at = base[:a] + t
            out[at] = state[:a]
            state[:a] = np.where(stay[at, state[:a]], state[:a], best[at])
        place = np.repeat(f - base, n) + np.arange(len(best))
        return place, out, state[back]

    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    return v[back], label


def viterbi(e: np.ndarray, first: np.ndarray, penalty: float = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """Best labels of the words of each text (first: their first words and the end)."""
    langs = e.shape[1]
    length = np.diff(first)
    if langs > MANY:
        chunk = max(int(length.max(initial=0)), 1)
    short = np.flatnonzero((length > 0) & (length <= chunk))
    lanes_first, lanes_len, start = [first[:-1][short]], [length[short]], [np.zeros((len(short), langs))]
    chains = []
    eye = np.where(np.eye(langs, dtype=bool), 0.0, -1e18)
    at = len(short)
    for d in np.flatnonzero(length > chunk).tolist():
        cuts = np.arange(first[d], first[d + 1], chunk)
        chains.append((at, len(cuts)))
        lanes_first.append(np.repeat(cuts, langs))
        lanes_len.append(np.repeat(np.minimum(chunk, first[d + 1] - cuts), langs))
        start.append(np.tile(eye, (len(cuts), 1)))
        at += len(cuts) * langs
    final, label = _lockstep(e, np.concatenate(lanes_first), np.concatenate(lanes_len), np.concatenate(start), penalty)
    last = final.argmax(1)
    use = np.zeros(at, bool)
    use[: len(short)] = True
    for lo, n in chains:  # (entry, exit) scores of the chunks, chained
        step = final[lo : lo + n * langs].reshape(n, langs, langs)
        v, came = np.zeros(langs), []
        for k in range(n):
            through = v[:, None] + step[k]
            came.append(through.argmax(0))
            v = through.max(0)
        out = int(v.argmax())
        for k in range(n - 1, -1, -1):
            entry = int(came[k][out])
            use[lo + k * langs + entry], last[lo + k * langs + entry] = True, out
            out = entry
    place, got, _ = label(last)
    # places are in the order of the lockstep: sorted by length, stable
    order = np.argsort(-np.concatenate(lanes_len), kind="stable")
    keep = np.repeat(use[order], np.concatenate(lanes_len)[order])
    out = np.zeros(len(e), got.dtype)
    out[place[keep]] = got[keep]
    return out


def solve(e: np.ndarray, start: np.ndarray, penalty: float = SWITCH, chunk: int = CHUNK):
    """Viterbi over words that go on from given scores: final scores, and a function that gives the words' labels and
    the label before them for a given final label."""
    n, langs = e.shape
    if not n:
        return start, lambda last: (np.zeros(0, np.int64), last)
    if langs > MANY:
        final, label = _lockstep(e, np.zeros(1, np.int64), np.array([n]), start[None], penalty)

        def trace(last: int) -> tuple[np.ndarray, int]:
            _, out, before = label(np.array([last]))
            return out, int(before[0])

        return final[0], trace
    cuts = np.arange(0, n, chunk)
    lanes, size = np.repeat(cuts, langs), np.repeat(np.minimum(chunk, n - cuts), langs)
    final, label = _lockstep(e, lanes, size, np.tile(np.where(np.eye(langs, dtype=bool), 0.0, -1e18), (len(cuts), 1)), penalty)
    v, came = start, []
    for step in final.reshape(len(cuts), langs, langs):
        through = v[:, None] + step
        came.append(through.argmax(0))
        v = through.max(0)

    def trace(last: int) -> tuple[np.ndarray, int]:
        ends, use = final.argmax(1), np.zeros(len(lanes), bool)
        for k in range(len(cuts) - 1, -1, -1):
            entry = int(came[k][last])
            use[k * langs + entry], ends[k * langs + entry] = True, last
            last = entry
        place, got, _ = label(ends)
        order = np.argsort(-size, kind="stable")
        keep = np.repeat(use[order], size[order])
        out = np.zeros(n, got.dtype)
        out[place[keep]] = got[keep]
        return out, last

    return v, trace


def _long(text: str, m: Model, limit: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(letters of each language, spans as (label, first word, words)) of one text, a part at a time."""
    cut = list(parts(text, limit))
    starts, words = [np.zeros(len(m.langs))], [0]
    for part in cut:
        t = Text([part])
        starts.append(solve(emissions(t, m), starts[-1])[0])
        words.append(words[-1] + len(t.w))
    share, spans, last = np.zeros(len(m.langs)), [], int(starts[-1].argmax())
    for k in range(len(cut) - 1, -1, -1):
        t = Text([cut[k]])
        label, last = solve(emissions(t, m), starts[k])[1](last)
        share += np.bincount(label, t.letters, minlength=len(m.langs))
        for lang, first, n in reversed(_runs(label)):
            if spans and spans[-1][0] == lang:
                spans[-1] = (lang, words[k] + first, n + spans[-1][2])
            else:
                spans.append((lang, words[k] + first, n))
    return share, spans[::-1]


def _runs(label: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, first place, length) of runs of equal labels."""
    if not len(label):
        return []
    at = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1])
    return list(zip(label[at].tolist(), at.tolist(), np.diff(np.append(at, len(label))).tolist()))


def _short(texts: list[str], m: Model, spans: bool) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """(letters of each language, spans) of texts, in lockstep."""
    t = Text(texts)
    label, langs = viterbi(emissions(t, m), t.w.first.astype(np.int64)), len(m.langs)
    share = np.bincount(t.w.doc * langs + label, t.letters, minlength=len(texts) * langs).reshape(-1, langs)
    first = t.w.first.tolist()
    return share, [_runs(label[a:b]) for a, b in zip(first, first[1:])] if spans else []


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with spans also spans: array<struct<lang, first_word, n_words>>. The model is sent to the
    workers: languages x 65,537 floats, a quarter of a MB a language."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.allowed))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    limit = min(max(SLICE_WORK // max(len(model.langs), 1), SLICE_LEAST), SLICE_MOST)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            null = batch["text"].is_null().to_pylist()
            for i, j, texts in _blocks(batch, limit):
                lettered = np.array([not n and any(map(str.isalpha, x)) for n, x in zip(null[i:j], texts)], bool) & bool(m.langs)
                share, runs = np.zeros((j - i, max(len(m.langs), 1))), [[] for _ in texts]
                if m.langs and j - i == 1 and len(texts[0]) > limit:
                    share[0], runs[0] = _long(texts[0], m, limit)
                elif m.langs:
                    share, found = _short(texts, m, spans)
                    runs = found or runs
                total, top = share.sum(1), share.argmax(1)
                # letters outside the ranges known here: a text has letters but no share; the first language stands
                score = np.where(lettered, np.where(total > 0, share.max(1) / np.maximum(total, 1), 1 / share.shape[1]), 0.0)
                pred = [m.langs[k] if ok else "und" for k, ok in zip(top.tolist(), lettered.tolist())]
                cols = [batch["doc_id"].slice(i, j - i), pa.array(pred, pa.string()), pa.array(score)]
                if spans:
                    rows = [[{"lang": m.langs[k], "first_word": a, "n_words": n} for k, a, n in x] if ok else [] for x, ok in zip(runs, lettered.tolist())]
                    cols.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    shape = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang: string, first_word: long, n_words: long>>" * spans
    return docs.select("doc_id", "text").mapInArrow(of, shape)
