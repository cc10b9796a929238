"""The stages of the pipeline against brute force, on the smallest table with a few rows made odd."""

import base64
import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import byte_bpe, queries, surrogates

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in rows}
    long = max(texts.values(), key=len)
    odd = [(9000, None, None, None, 0), (9001, "", "en", "src1", 0), (9002, long, "en", None, 1), (9003, long + " one word more", None, "src1", 1), (9004, "short text", "en", "src1", 1)]
    return d.union(spark.createDataFrame(odd, d.schema)).repartition(3)


def test_rules(spark, docs, sf_dir):
    menu = [(8000 + i, f"Home | About  us\nwords of page {i} and " + " ".join(f"w{i}x{k}" for k in range(12)) + "\nHOME | about us", "en", "menus", 1) for i in range(15)]
    menu += [(8100 + i, f"home | about us\nonly {i}", "en", "menus", 1) for i in range(3)] + [(8200 + i, "an exact copy of a page that stands in the table very often indeed\nand has two lines", "en", "menus", 1) for i in range(20)]
    docs = docs.union(spark.createDataFrame(menu, docs.schema))
    out = STAGES["quality rules"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = docs.collect()
    norm = lambda line: b" ".join(line.lower().encode().split())
    texts, hosts = {}, Counter(r.source for r in rows)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if norm(line):
                texts.setdefault((r.source, norm(line)), set()).add(r.text)
    bad = {k for k, v in texts.items() if len(v) > 10 and len(v) > min(0.02 * hosts[k[0]], 1000)}
    want = {}
    for r in rows:
        w = (r.text or "").encode().split()
        grams = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        again = {q for p in range(len(w) - 4) if grams[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
        left = [x for x in (r.text or "").split("\n") if (r.source, norm(x)) not in bad]
        n = sum(len(norm(x).split()) for x in left)
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and n >= 10 and n >= 0.2 * len(w):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert {9000, 9001, 9004, 8100}.isdisjoint(want) and len(want) > 100 and "ome" not in want[8003] and 8205 in want


def test_near_duplicates(spark, docs, sf_dir):
    out = STAGES["near duplicates"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    sets = {}
    for r in docs.collect():
        w = [x.lower() for x in (r.text or "").encode().split()]
        sets[r.doc_id] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in out.collect()) == [i for i in ids if find(i) == i]


def test_personal_data(spark, docs, sf_dir):
    out = STAGES["personal data"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    after = {r.doc_id: r.text for r in out.collect()}
    pattern = re.compile(r"[\w.]+@[\w-]+(?:\.[\w-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|(?<!\d)\d{16}(?!\d)|[0-9a-f]{40}|[0-9A-F]{40}")

    def card(x):  # of an issuer's form, with a true check digit
        d = [int(c) for c in x][::-1]
        return re.match("4|5[1-5]|2[2-7]|35|6011|65|64[4-9]|62", x) and (sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0

    seen = 0
    for r in docs.collect():
        if r.text is None:
            assert after[r.doc_id] is None
            continue
        found = pattern.findall(r.text)
        numbers = [x for x in found if re.fullmatch(r"\d{16}", x) and not card(x)]
        assert all(x in after[r.doc_id] for x in numbers), r.doc_id
        found = [x for x in found if x not in numbers]
        seen += len(found)
        assert not [x for x in found if x in after[r.doc_id]], r.doc_id
        if not found and "Mr" not in r.text:
            assert after[r.doc_id] == r.text
    assert seen > 5


def test_mix(spark, docs, sf_dir):
    out = STAGES["mix"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 2 and all(before[r.doc_id] == r for r in after)
    words = {i: len((r.text or "").encode().split()) for i, r in before.items()}
    total = sum(words.values())
    assert abs(sum(words[i] * n for i, n in copies.items()) - 1.5 * total) < 0.1 * total


def test_tokens_and_the_whole(spark, docs, sf_dir):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(corpus_pipeline.RANKS), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in STAGES["tokens"](spark, docs, sf_dir).collect()}
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, sf_dir)
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, step.collect())) == sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect()))


def test_tokens_in_small_batches(spark, docs, sf_dir, monkeypatch):
    def sizes(docs, path):
        def of(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

        return docs.select("doc_id", "text").mapInArrow(of, "bytes long, rows long")

    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(byte_bpe, "digests", sizes)
    many = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', if(id = 7, 1000000, 1000)) AS text")
    before = spark.conf.getAll
    found = STAGES["tokens"](spark, many, sf_dir).collect()
    assert spark.conf.getAll == before
    assert sum(r.rows for r in found) == 3000 and len(found) > 5 and sum(r.bytes > 5 << 20 for r in found) <= 1


def test_empty_table(spark, docs, sf_dir):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), sf_dir).count() == 0, name


@pytest.mark.parametrize("name", ["op1_mixing", "op2_language_id", "op5_quality_fm", "op7_byte_bpe", "op10_surrogates"])
def test_queries_without_sql_give_a_row_a_document(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = queries.queries()[name](spark, sf_dir)
    assert out.count() == n and out.select("doc_id").distinct().count() == n
    again = queries.queries()[name](spark, sf_dir)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_entities_are_found_by_the_pattern_alone():
    assert set(surrogates.PATTERNS) == {"email", "secret", "phone", "ip", "card", "ssn", "iban", "name"}
