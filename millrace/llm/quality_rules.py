"""Quality rules: document statistics, and lines that many documents of one host share.

Base rules reject very short and very repetitive documents. The cross-document rule hashes normalised lines (lower
case, white space collapsed), counts for each host the distinct documents that hold a line, removes lines above the
host's limit and rejects documents of which too little is left. Exact copies of one document are not distinct documents:
two documents count once if their whole texts have the same digest, so a group of thousands of copies is left for the
duplicate stage, while menus and notices are found however many lines the documents share, and so are documents that are
one same line but for case or white space.

A line that a third of all documents hold is one row a task when counted. The lines above the limits are joined by
broadcast once they are counted as few (BROADCAST_LINES); beyond that both sides are dealt out over SALTS parts a line.

Defined results: a null text counts as no words and fails the base rule; a null host is a host of its own; repeated
rows of one doc_id, and rows without one, are judged each; an empty table gives an empty table; other columns are carried by apply() only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import sized_join, written
from ._words import U, Words, mix, slices, sums, utf8, windows

#: A line goes when more distinct documents of its host hold it than both of these allow,
LINE_MIN_DOCS, LINE_MAX_SHARE = 10, 0.02
#: and above so many documents whatever the share: the limit does not grow without bound with the host.
LINE_MOST_DOCS = 1000
#: What must be left after the lines went: words, and share of the words.
LEFT_MIN_WORDS, LEFT_MIN_SHARE = 10, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5
#: At most so many lines above the limits (digest and host, some 100 bytes each in a hash table) are broadcast.
BROADCAST_LINES, SALTS = 250_000, 32
#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_md5 binary, lines array<binary>, line_words array<int>"
_STATS = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("text_md5", pa.binary()), ("lines", pa.list_(pa.binary())), ("line_words", pa.list_(pa.int32()))]
)


def repeated(w: Words, h: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a window that holds it occurs twice or more in its document. Windows of equal hashes are
    compared by digests of their words."""
    at = w.valid(width)
    covered = np.zeros(len(w) + 1, np.int64)
    if len(at):
        x = mix(windows(h, at, width) ^ mix(w.doc[at].astype(U)))
        order = np.argsort(x)
        same = x[order[1:]] == x[order[:-1]]
        like = np.zeros(len(at), bool)
        like[order[1:][same]] = True
        like[order[:-1][same]] = True
        at = at[like]
        name = np.column_stack([w.digests(at, width), w.doc[at].astype(U)])
        order = np.lexsort(name.T)
        same = (name[order[1:]] == name[order[:-1]]).all(1)
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return np.cumsum(covered)[: len(w)] > 0


def _lines(text: bytes) -> tuple[list[bytes], list[int], int]:
    """Digests and word counts of the lines (without a word: no digest), and how many equal an earlier one."""
    seen: set[bytes] = set()
    digests, counts, again = [], [], 0
    for raw, low in zip(text.split(b"\n"), text.decode().lower().encode().split(b"\n")):
        words = low.split()
        counts.append(len(words))
        if not words:
            digests.append(b"")
            continue
        again += raw in seen
        seen.add(raw)
        digests.append(hashlib.md5(b" ".join(words)).digest())
    return digests, counts, again


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        data, offsets = utf8(batch["text"])
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j)
            covered = repeated(w, w.hashes(), REPEAT_WIDTH)
            inside = np.zeros(len(w.data) + 1, np.int8)
            inside[w.starts] += 1
            np.subtract.at(inside, w.ends, 1)
            inside = np.cumsum(inside[:-1]) > 0
            texts = [w.data[a:b].tobytes() for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
            found = [_lines(x) for x in texts]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["host"],
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(sums(inside & ((w.data & 0xC0) != 0x80), w.bounds)),
                    pa.array(sums(symbol[w.data], w.bounds)),
                    pa.array([x[2] for x in found], pa.int64()),
                    pa.array(sums(covered, w.first)),
                    pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()),
                    pa.array([x[0] for x in found], pa.list_(pa.binary())),
                    pa.array([x[1] for x in found], pa.list_(pa.int32())),
                ],
                schema=_STATS,
            )


def line_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    return docs.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(_stats, STATS)


def frequent_lines(stats: DataFrame) -> DataFrame:
    """(host, line) of the lines held by more distinct documents of the host than the limits allow."""
    distinct = F.array_distinct(F.filter("lines", lambda x: F.length(x) > 0))
    each = stats.select("host", F.explode(distinct).alias("line"), "text_md5")
    docs_of = each.groupBy("host", "line", "text_md5").agg(F.lit(1)).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    hosts = stats.groupBy("host").agg(F.count("*").alias("host_docs"))
    over = docs_of.where(F.col("n_docs") > LINE_MIN_DOCS).join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return over.where(F.col("n_docs") > F.least(LINE_MAX_SHARE * F.col("host_docs"), F.lit(LINE_MOST_DOCS))).select("host", "line")


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Statistics of each document, its verdict (base_failed, kept), and the places of its lines that go (dropped)."""
    return _judged(docs, host).drop("host", "text_md5")


def _judged(docs: DataFrame, host: str) -> DataFrame:
    stats = written(line_statistics(docs, host).withColumn("row", F.monotonically_increasing_id()), "stats")
    bad = written(frequent_lines(stats).withColumnsRenamed({"host": "of", "line": "bad"}), "lines")
    at = stats.select("row", "host", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "x"))
    at = at.select("row", "host", "place", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n")).where(F.length("line") > 0)
    if bad.count() <= BROADCAST_LINES:
        hit = at.join(F.broadcast(bad), (F.col("line") == F.col("bad")) & F.col("host").eqNullSafe(F.col("of")))
    else:
        salted = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = at.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        hit = at.join(salted.hint("merge"), (F.col("line") == F.col("bad")) & (F.col("salt") == F.col("part")) & F.col("host").eqNullSafe(F.col("of")))
    gone = hit.groupBy("row").agg(F.sum("n").alias("words_gone"), F.sort_array(F.collect_list("place")).alias("dropped"))
    out = stats.drop("lines", "line_words").join(gone, "row", "left").drop("row")
    left = F.col("n_words") - F.coalesce("words_gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = (left >= LEFT_MIN_WORDS) & (left >= LEFT_MIN_SHARE * F.col("n_words"))
    return out.withColumns({"words_gone": F.coalesce("words_gone", F.lit(0)), "base_failed": failed, "kept": ~failed & fine})


def _name(doc_id: Column, host: Column, text_md5: Column) -> Column:
    """What a row is known by, nulls told from values."""
    parts = [F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("")) for x in (doc_id, host)]
    return F.unhex(F.md5(F.concat_ws("\x1f", text_md5, *parts)))


def apply(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents kept, with all their columns, without the lines that went. Edits belong to (doc_id, host, text), not
    to the doc_id alone: rows that are equal in these have one verdict."""
    found = _judged(docs, host).where(~F.col("kept") | F.col("dropped").isNotNull())
    found = found.select(_name(F.col("doc_id"), F.col("host"), F.lower(F.hex("text_md5"))).alias("name"), "kept", "dropped")
    edits = written(found.dropDuplicates(["name"]), "edits")
    name = _name(F.col("doc_id"), F.col(host), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"), "text")  # whatever else docs has cannot clash
    both = sized_join(rows, edits, "name")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return both.where(F.coalesce("kept", F.lit(True))).select(F.col("row").withField("text", text).alias("row")).select("row.*")
