"""Learnt operators on held-out rows; embeddings and licences against brute force; odd cases."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_join, language_id, license_scan, quality_fm

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_on_held_out_texts(spark, documents):
    held = documents.withColumn("held", language_id.held_out())
    model = language_id.train(held.where("not held"))
    got = held.join(language_id.identify(documents.drop("lang", "source"), model), "doc_id")
    right = got.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and got.where("score < 0 or score > 1").count() == 0

    texts = {r.lang: r.text for r in documents.where("n_chars between 800 and 3000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    en, fr = " ".join(texts["en"].split()[:60]), " ".join(texts["fr"].split()[:60])
    odd = [(1, None), (2, ""), (3, " 12 !? \n"), (4, en + "\n" + fr), (5, "x" * 100000), (6, fr), (6, fr), (7, "Привет мир"), (8, ". " + en)]
    rows = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(odd, "doc_id long, text string"), model, spans=True).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [rows[k].score for k in (1, 2, 3)] == [0.0] * 3 and rows[3].spans == []
    assert [s.lang for s in rows[4].spans] == ["en", "fr"] and abs(rows[4].spans[1].first_word - 60) <= 2
    assert rows[6].lang_pred == "fr" and rows[5].lang_pred in model.langs and rows[8].lang_pred == "en"
    assert language_id.identify(documents.where("false"), model).count() == 0
    none = language_id.train(documents.where("false"))
    assert {r.lang_pred for r in language_id.identify(documents.limit(3), none).collect()} == {"und"}


def test_scripts_narrow_the_candidates():
    table = np.zeros((2, (1 << language_id.BITS) + 1), np.float32)
    allowed = np.zeros((2, len(language_id._NAMES)), bool)
    allowed[0, language_id._NAMES.index("latin")] = allowed[1, language_id._NAMES.index("cyrillic")] = True
    t = language_id.Text(["hello мир ça 12 日本"])
    e = language_id.emissions(t, language_id.Model(["la", "ru"], table, allowed))
    assert e[0, 0] == 0 and e[0, 1] == language_id.OUT and e[1, 0] == language_id.OUT and e[1, 1] == 0 and e[2, 1] == language_id.OUT
    assert (e[3] == 0).all() and (e[4] == 0).all() and t.letters.tolist() == [5, 3, 2, 0, 2]


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_viterbi_finds_the_best_path(chunk):
    rng = np.random.default_rng(chunk)
    e = rng.normal(size=(60, 3)).astype(np.float32) * 3
    first = np.array([0, 0, 1, 20, 20, 57, 60])
    got = language_id.viterbi(e, first, 2.0, chunk)
    for a, b in zip(first[:-1], first[1:]):
        v, back = np.zeros(3), []
        for t in range(a, b):
            move = v[:, None] - 2.0 * (1 - np.eye(3))
            back.append(move.argmax(0))
            v = move.max(0) + e[t]
        value = lambda path: sum(e[a + k, s] for k, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        if b > a:
            assert value(got[a:b]) == pytest.approx(v.max(), abs=1e-4)


def test_quality_on_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = language_id.held_out()
    machine = quality_fm.train(documents, labels.where(~held))
    scored = quality_fm.score(documents, machine)
    rows = scored.join(labels, "doc_id").where(held).select("score", "quality").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]])
    assert auc > 0.9 and np.mean((s >= 0.5) == y) > 0.9
    odd = spark.createDataFrame([(1, None, None), (2, "", 0), (3, "a " * 50000, 5), (4, "x", 1), (4, "x", 1)], "doc_id long, text string, n_chars long")
    got = quality_fm.score(odd, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_fm.score(documents.where("false"), machine).count() == 0
    none = quality_fm.train(documents, labels.where("false"))
    assert {r.score for r in quality_fm.score(odd, none).collect()} == {0.5}


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)), None, None)
    col, x = np.array([1, 5, 9, 2]), rng.normal(size=4)
    pairs = sum(m.factors[col[a]] @ m.factors[col[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.margins(col, x, np.array([0, 4, 4])).tolist() == pytest.approx([0.3 + m.linear[col] @ x + pairs, 0.3])


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(12, 64))
    for k in range(200):
        v = base[k % 12] + rng.normal(size=64) * rng.choice([0.0, 0.08, 0.14, 0.2, 0.6])
        rows.append((k, v.astype(np.float32).tolist(), k % 3 if k % 17 else None))
    one = rows[30]
    rows += [(1000 + k, one[1], one[2]) for k in range(40)] + [(2000, [2 * x for x in one[1]], one[2]), (2001, [-x for x in one[1]], one[2])]
    rows += [(3000, None, 0), (3001, [0.0] * 64, 0), (3002, [float("nan")] * 64, 0), (3003, [None] * 64, 0), (3004, [], 0), (3005, [1.0, float("inf")], 0), (3006, [1.0, 2.0, 3.0], 0), (3007, [1.0, 2.0, 3.01], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    sound = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    links = {r[0]: set() for r in rows}
    for i, a in enumerate(sound):
        for b in sound[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    root = {}
    for k in sorted(links):
        todo = [k] if k not in root else []
        while todo:
            n = todo.pop()
            if n not in root:
                root[n] = k
                todo += links[n]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.link(df).collect()}
    assert got == {k: (len(links[k]), root[k], root[k] == k) for k in links}
    assert max(v[0] for v in got.values()) > 40
    assert embedding_join.link(df.where("false")).count() == 0


def test_embedding_links_of_a_cell_that_is_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    rows = [(k, (centre + rng.normal(size=64) * 0.1).tolist(), "x") for k in range(300)] + [(1000 + k, rng.normal(size=64).tolist(), "x") for k in range(200)]
    rows += [(2000 + k, rows[5][1], "x") for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(6)
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = dict(zip([r[0] for r in rows], ((e @ e.T >= 0.98).sum(1) - 1).tolist()))
    assert max(want.values()) > 250
    for cell, ids in ((embedding_join.CELL, embedding_join.BROADCAST_IDS), (40, -1)):
        monkeypatch.setattr(embedding_join, "CELL", cell)
        monkeypatch.setattr(embedding_join, "BROADCAST_IDS", ids)
        assert {r.vec_id: r.n_links for r in embedding_join.link(df).collect()} == want


def test_rows_of_cells_follow_their_vectors_not_their_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    n = 400
    x = rng.normal(size=64) + rng.normal(size=(n, 64)) * 0.01
    both = pa.array(np.concatenate([x, x]).tolist(), pa.list_(pa.float64()))
    two = lambda a: pa.array(np.concatenate([a, a]))
    side = pa.array(np.repeat([0, 1], n).astype(np.int32))
    turned = embedding_join._unit(x) @ embedding_join.rotation(64)
    batch = pa.RecordBatch.from_arrays([two(np.zeros(n, np.int64)), side, two(np.zeros(n, np.int32)), two(np.arange(n)), two(np.ones(n, np.int64)), pa.array(["l"] * 2 * n), both], names=["gid", "side", "block", "node", "n", "label", "embedding"])
    out = pa.Table.from_batches(embedding_join._linked(0.98)(iter([batch]))).to_pylist()
    assert len(turned) == n and len(out) <= 4 * n and sum(r["k"] for r in out) == n * (n - 1)
    assert {r["b"] for r in out if r["b"] is not None} == {0}


def test_forest():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    root = list(range(300))
    for _ in range(300):
        for p, q in zip(a.tolist(), b.tolist()):
            root[p] = root[q] = min(root[p], root[q])
    assert embedding_join.forest(300, a, b).tolist() == root


@pytest.mark.parametrize("chunk", [3, 100])
def test_viterbi_of_more_than_256_languages(chunk):
    best = [299, 0, 256, 255, 257, 298, 43, 299]
    e = np.full((len(best), 300), -9.0, np.float32)
    e[np.arange(len(best)), best] = 0
    assert language_id.viterbi(e, np.array([0, len(best)]), 1.0, chunk).tolist() == best


@pytest.mark.parametrize("langs", [3, 40])
def test_viterbi_part_by_part(langs):
    rng = np.random.default_rng(langs)
    e = rng.normal(size=(500, langs)).astype(np.float32) * 3
    want = language_id.viterbi(e, np.array([0, 500]), 2.0, 50)
    cuts, starts = [0, 1, 130, 130, 400, 500], [np.zeros(langs)]
    for a, b in zip(cuts, cuts[1:]):
        starts.append(language_id.solve(e[a:b], starts[-1], 2.0, 20)[0])
    last, got = int(starts[-1].argmax()), []
    for (a, b), v in reversed(list(zip(zip(cuts, cuts[1:]), starts))):
        label, last = language_id.solve(e[a:b], v, 2.0, 20)[1](last)
        got = label.tolist() + got
    value = lambda path: sum(e[k, s] for k, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
    assert value(got) == pytest.approx(value(want.tolist()), abs=1e-3)


def test_a_text_longer_than_a_slice_and_many_languages(spark, documents, monkeypatch):
    some = documents.where("lang is not null and text is not null")
    model = language_id.train(some)
    rng = np.random.default_rng(0)
    rows = some.where("n_chars > 2000").limit(60).select("text", "lang").collect()
    text = "\n".join(rows[k].text for k in rng.permutation(len(rows)))
    df = spark.createDataFrame([(1, text), (2, rows[0].text), (3, "word" * 40_000), (4, None)], "doc_id long, text string").coalesce(1)
    at_once = {r.doc_id: r for r in language_id.identify(df, model, spans=True).collect()}
    monkeypatch.setattr(language_id, "SLICE_WORK", 1)
    monkeypatch.setattr(language_id, "SLICE_LEAST", 3000)
    by_parts = {r.doc_id: r for r in language_id.identify(df, model, spans=True).collect()}
    assert at_once == by_parts and len(at_once[1].spans) > 5
    assert "".join(language_id.parts(text, 999)) == text and max(map(len, language_id.parts(text, 999))) <= 999
    many = language_id.Model([f"l{k:03}" for k in range(300)], np.repeat(model.table, 75, 0) + np.linspace(0, 1e-3, 300, dtype=np.float32)[:, None], np.repeat(model.allowed, 75, 0))
    names = {r.doc_id: r.lang_pred for r in language_id.identify(df, many).collect()}
    assert int(names[2][1:]) // 75 == model.langs.index(at_once[2].lang_pred) and names[4] == "und"


def test_licenses(spark):
    mit = license_scan.KNOWN["MIT text"]
    rows = [
        (1, "Copyright (c) 1999 Some Body\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", "  ,")),
        (2, "prose here\nlicensed under the apache licence; version 2.0\nReleased under the MIT License\nAll rights reserved."),
        (3, mit + " and more"), (4, None), (5, ""), (6, "!!!"), (7, mit), (7, mit), (8, "Licensed under CC BY NC 4.0"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, license_id string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[1].license_id == "MIT text" == got[7].license_id and got[3].license_id is None
    assert got[2].notices == "Apache-2.0,MIT" and got[2].license_id is None and got[8].license_id == "CC-BY-NC-4.0" == got[8].notices
    assert got[4].digest is None and got[5].digest == got[6].digest == hashlib.sha256(b"").hexdigest() and got[5].license_id is None
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.where("false")).count() == 0
    own = {r.doc_id: r.license_id for r in license_scan.scan(df, {"b": "!!! ", "a": "Mine"}).collect()}
    assert own[7] is None and own[5] is None


def test_notices_amid_prose(spark):
    header = license_scan.KNOWN["Apache-2.0 header"]
    words = header.split()
    wrapped = "\n".join(f" * {' '.join(words[k : k + 9])}" for k in range(0, len(words), 9))
    source = f"/*\n * Copyright 2020 Some Body\n{wrapped}\n */\nint main() {{}}\n"
    rows = [
        (1, source, "Apache-2.0,Apache-2.0 header", ""),
        (2, "// SPDX-License-Identifier: MIT\ncode", "", "MIT"),
        (3, "# SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0\n# SPDX-License-Identifier: 0BSD", "", "0BSD,Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0"),
        (4, "some words, released\nunder the MIT\nLicense. Other words", "MIT", ""),
        (5, "rereleased under the MIT License", "", ""),
        (6, "released under the MIT Licensed", "", ""),
        (7, license_scan.KNOWN["MIT text"] + " and more", "MIT text", ""),
        (8, "x " * 200_000 + "Released under the MIT License. Released under the MIT License.", "MIT", ""),
        (9, None, "", ""), (10, "", "", ""), (11, "released", "", ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.notices, r.spdx) for r in license_scan.scan(df).collect()) == [(i, n, x) for i, _, n, x in rows]
    own = {"plain": "no word that hints", "one": "Zyzzyva", "long": "w " * 1000}
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(1, "some NO-word\nthat hints, zyzzyva"), (2, "w " * 1000), (3, "w " * 1001)], "doc_id long, text string"), own).collect()}
    assert [got[k].notices for k in (1, 2, 3)] == ["one,plain", "", ""] and [got[k].license_id for k in (1, 2, 3)] == [None, "long", None]


def test_whole_licenses(spark):
    import textwrap

    isc = (
        "ISC License\n\nCopyright (c) 2020, Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
        'provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\n'
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY\nSPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER\n"
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,\nNEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE\nUSE OR PERFORMANCE OF THIS SOFTWARE.\n"
    )
    texts = {p.stem: p.read_text() for p in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib"} <= set(texts)
    wrap = lambda t: "\n\n".join(textwrap.fill(" ".join(p.split()), 60, break_on_hyphens=False) for p in t.split("\n\n"))
    rows = [(k, f"{k} text") for k in texts]
    docs = [(k, v) for k, v in texts.items()]
    docs += [(f"mine {k}", f"Copyright 2021 Some Body. All rights reserved.\n\n{wrap(texts[k])}") for k in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib")]
    rows += [(f"mine {k}", f"{k} text") for k in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib")]
    docs += [("isc", isc), ("apache", texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Some Body")), ("terms", texts["Apache-2.0"].split("   APPENDIX")[0])]
    docs += [("mit", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrap(license_scan.KNOWN["MIT text"])), ("more", isc + "and more"), ("half", isc[:300])]
    rows += [("isc", "ISC text"), ("apache", "Apache-2.0 text"), ("terms", "Apache-2.0 text"), ("mit", "MIT text"), ("more", None), ("half", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert {r.doc_id: r.license_id for r in license_scan.scan(df).collect()} == dict(rows)
