"""Equal hashes are not taken for equal words: structured words that fooled polynomial hashes, and forced collisions."""

import base64
import hashlib

import numpy as np
import pytest

from millrace.llm import _common, _words, byte_bpe, ngram_join, quality_rules, substring_dedup


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


@pytest.fixture(params=["own", "colliding"])
def hashes(request, monkeypatch):
    """The hashes as they are, and hashes of so few bits that everything collides. Local workers inherit no patch, so
    the operators' functions are called on batches here."""
    if request.param == "colliding":
        monkeypatch.setattr(_words, "mix", lambda x: x & np.uint64(1))
        monkeypatch.setattr(_words, "_ODD", np.uint64(0))
        monkeypatch.setattr(_words, "_SEEDS", np.zeros(4, np.uint64))


def test_words_differ():
    for a, b in TWINS:
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        w = _words.Words(data, np.array([0, len(data)]), 0, 1)
        assert all(len(set(w.hashes(k).tolist())) == 2 for k in range(4)) and len(set(map(tuple, w.digests(np.array([0, 1]), 1).tolist()))) == 2
    seq = [thue_morse(4096)[k] for k in range(4096)]
    text = " ".join(seq + [{"a": "b", "b": "a"}[x] for x in seq]).encode()
    w = _words.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1)
    assert len(set(_words.windows(w.hashes(), np.array([0, 4096]), 4096).tolist())) == 2


def test_byte_bpe_tells_pieces_apart(spark, hashes):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [x for pair in TWINS for x in pair] + ["the cat sat", "on the mat", ""]
    replay = byte_bpe.Replay(open(path, "rb").read())
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = []
    for _ in range(2):  # the second time, what the first has learnt is known
        got.append([])
        for _, _, ids, n in replay.corpus(data, offsets, 0, len(texts)):
            got[-1] += np.split(ids, np.cumsum(n)[:-1])
    for found in got:
        assert [x.tolist() for x in found] == [own.encode_ordinary(t) for t in texts]
    rows = byte_bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_substring_dedup_tells_words_apart(spark):
    rows = []
    for k, (a, b) in enumerate(TWINS):
        same = [f"x{i}" for i in range(60)]
        rows += [(2 * k, " ".join([f"{k}", *same[:30], a, *same[30:]])), (2 * k + 1, " ".join([f"{k}", *same[:30], b, *same[30:]]))]
    got = substring_dedup.dedup(spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1)).collect()
    assert all(r.n_removed == 0 for r in got)
    got = substring_dedup.dedup(spark.createDataFrame([*rows[:2], (9, rows[1][1])], "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {0: 0, 1: 0, 9: 62}


def test_ngram_join_tells_shingles_apart(spark):
    rows = [x for k, (a, b) in enumerate(TWINS) for x in ((2 * k, f"q{k} {a}"), (2 * k + 1, f"q{k} {b}"))]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got) and len(got) == 6


def test_repeated_words_are_compared(hashes):
    a, b = TWINS[0]
    text = f"1 2 {a} 3 4 5 6 7 1 2 {b} 3 4 8 8 8 8 8 8".encode()
    w = _words.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1)
    assert quality_rules.repeated(w, w.hashes(), 5).tolist() == [False] * 13 + [True] * 6


def test_spans(hashes):
    r = np.random.default_rng(1)
    x = r.integers(97, 99, 4000).astype(np.uint8)
    at, to, size = r.integers(0, 3900, 3000), r.integers(0, 3900, 3000), r.integers(0, 100, 3000)
    size[:1500] = r.integers(0, 4, 1500)
    want = [bytes(x[a : a + n]) == bytes(x[b : b + n]) for a, b, n in zip(at, to, size)]
    assert _words.equal_spans(x, at, x, to, size).tolist() == want and any(want[:1500])


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 400)]
    hub = [(1000, k) for k in range(1001, 1400)]
    cycle = [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)]
    odd = [(5, 5), (None, 7), (3000, 3001), (3001, 3000), (3000, 3001), (-(2**62), 2**62)]
    edges = spark.createDataFrame([*chain, *hub, *cycle, *odd], "a long, b long").repartition(6)
    got = {r.id: r.component for r in _common.components(edges).collect()}
    want = {k: 100 for k in range(100, 401)} | {k: 1000 for k in range(1000, 1400)} | {k: 2000 for k in range(2000, 2050)}
    assert got == want | {3000: 3000, 3001: 3000, -(2**62): -(2**62), 2**62: -(2**62)}
    assert _common.components(edges.where("false")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _common.shared_folder(Session)
