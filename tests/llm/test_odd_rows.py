"""Rows without an id, repeated rows, ids with several texts, extra columns with clashing names, one very long word."""

import base64
import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import byte_bpe, embedding_join, license_scan, ngram_join, quality_rules, substring_dedup, surrogates

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (None, "a text without an id but with words of its own and enough of them", "en", "s"), (None, None, None, None), (None, LONG, "en", "web"), (1, LONG, "en", "web"), (1, LONG, "en", "web"),
    (2, LONG, None, None), (3, LONG + " other end", "en", "web"), (4, None, "en", "s"), (5, "", None, None), (6, " \n\t", "en", "s"), (7, "x" * 100_000, "en", "s"), (7, "another text of the same id with ten words or more in it", "en", "s"),
]
CLASHING = ["row", "key", "n", "host", "size", "lines", "class_id", "name", "of", "part", "edits", "dropped", "ids", "decoded", "_entities", "Text_md5"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(2).cache()


def by_id(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), *r[1:]) for r in df.collect())


def test_links(docs):
    out = ngram_join.link(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert len(out) == len(ROWS)
    assert all(r.component_id is None for r in out if r.doc_id is None)
    of = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert sorted(r.n_shingles for r in out if r.doc_id == 7) == [1, len(ROWS[-1][1].split()) - 2]


def test_near_duplicates_keep_one_of_repeated_rows(spark, docs, sf_dir):
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 7] and ids.count(None) == 3


def test_rules_judge_rows_without_an_id_and_do_not_multiply(spark, docs):
    out = quality_rules.apply(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text) for r in out.collect())
    want = sorted((i or 0, t) for i, t, *_ in ROWS if len((t or "").split()) >= 10)
    assert kept == want
    menu = [(None if k % 2 else k, f"Home | About us\n{LONG} page {k}", "en", "m") for k in range(20)] * 2
    menu = spark.createDataFrame(menu, "doc_id long, text string, lang string, source string")
    texts = [r.text for r in quality_rules.apply(menu).collect()]
    assert len(texts) == 40 and sorted(texts) == sorted(f"{LONG} page {k}" for k in range(20) for _ in range(2))


def test_passages(docs):
    out = substring_dedup.dedup(docs).collect()
    assert len(out) == len(ROWS)
    removed = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in out)
    gone = {(2, 60): 60, (3, 62): 60}
    counts = [(i or 0, len((t or "").split())) for i, t, *_ in ROWS]
    assert removed == sorted((i, n, gone.get((i, n), 0)) for i, n in counts)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    v, u = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    rows = [(None, v, 1), (None, v, 1), (1, v, 1), (1, v, 1), (2, v, 1), (3, u, 1), (4, v, None), (5, None, 1), (6, v, 1), (6, v, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "n", "key", "name", "sound", "x")})
    got = [tuple(r) for r in embedding_join.link(df).collect()]
    assert got.count((None, 0, None, True)) == 2
    assert sorted(r for r in got if r[0]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_others_keep_every_row(spark, docs, sf_dir):
    assert license_scan.scan(docs).count() == len(ROWS)
    out = surrogates.replace(docs, "k")
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(t) for _, t, *_ in ROWS) and out.columns == [*docs.columns, "_entities_"]
    public = pytest.importorskip("public_tokenizers")
    found = byte_bpe.digests(docs, public.path(corpus_pipeline.RANKS)).collect()
    assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)


@pytest.mark.parametrize("unit, times", [("x", 300_000), ("the", 60_000), (" ", 200_000), ("=-", 100_000), ("wxyzabcaab", 20_000), ("é中", 30_000)])
def test_one_very_long_piece(unit, times, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    raw = open(public.path(corpus_pipeline.RANKS), "rb").read()
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    replay = byte_bpe.Replay(raw)

    def encode(text):
        data = np.frombuffer(text.encode(), np.uint8)
        replay.forget()
        return np.concatenate([ids for _, _, ids, _ in replay.corpus(data, np.array([0, len(data)]), 0, 1)])

    whole = encode("a " + unit * times + " z")
    assert replay.decode(whole)[0].tobytes() == ("a " + unit * times + " z").encode()
    short = "a " + unit * 300 + " z"
    by_heap = encode(short).tolist()
    monkeypatch.setattr(byte_bpe, "LONG", 1 << 30)
    assert by_heap == encode(short).tolist() == own.encode_ordinary(short)


def test_tokens_of_new_words_take_bounded_memory():
    public = pytest.importorskip("public_tokenizers")
    replay = byte_bpe.Replay(open(public.path(corpus_pipeline.RANKS), "rb").read())
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(w) for w in rng.choice(list("etaoinshrdlu"), (700, 9))).encode() for _ in range(1100)]  # nearly no word twice
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    for i, j in byte_bpe._corpora(offsets):
        for a, b, ids, n in replay.corpus(data, offsets, i, j):
            assert replay.decode(ids)[0].tobytes() == b"".join(texts[a:b])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(data)
