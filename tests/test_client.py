"""The object calls end to end, on a bucket in a temporary folder."""

import pytest

from millrace.operators.scan import ScanQuery, decode_token
from millrace.sources.client import Objects
from millrace.sources.store import Bucket


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Objects(Bucket(spark, str(tmp_path_factory.mktemp("objects") / "b"), 2), chunk=4, min_part=3)


def test_objects(store, spark):
    store.put_all(spark.createDataFrame([("a/1", bytearray(b"0123456789")), ("a/2", bytearray(b"")), ("b", bytearray(b"xyz"))], "key string, data binary"))
    assert store.get("a/1") == b"0123456789" and store.get("a/2") == b"" and store.get("zz") is None
    assert [store.get("a/1", *r) for r in ((2, 6), (7,), (-1, 3), (8, 99))] == [b"23456", b"789", b"789", b"89"]
    assert store.get("a/1", 10) is None and store.get("a/2", 0, 5) is None
    h = store.head("a/1")
    assert h.length == 10 and len(h.etag) == 32 and store.head("zz") is None
    page = store.list(ScanQuery(limit=2), "/")
    assert page["prefixes"] == ["a/"] and page["keys"] == [] and decode_token(page["next"]) == "a/2"
    assert [r.key for r in store.list(ScanQuery(after="a/2"))["keys"]] == ["b"]
    store.put("b", b"new")
    store.copy("b", "c")
    store.rename("a/1", "d/1")
    assert store.get("b") == store.get("c") == b"new" and store.get("a/1") is None and store.get("d/1") == b"0123456789"
    store.delete("b", "never there")
    store.delete_prefix("a/")
    assert sorted(r.key for r in store.list()["keys"]) == ["c", "d/1"]
    with pytest.raises(KeyError):
        store.copy("b", "e")
    with pytest.raises(ValueError):
        store.rename("c", "c")


def test_multipart(store):
    u = store.create_upload("m")
    one, two = store.upload_part(u, 1, b"hello "), store.upload_part(u, 2, b"wor")
    two = store.upload_part(u, 2, b"world")
    assert [r.key for r in store.uploads().collect()] == ["m"] and store.parts(u).count() == 2
    with pytest.raises(ValueError):
        store.complete_upload(u, [(1, one), (2, two + 1)])
    store.complete_upload(u, [(1, one), (2, two)])
    assert store.get("m") == b"hello world" and store.get("m", 4, 7) == b"o wo" and store.uploads().count() == 0
    with pytest.raises(KeyError):
        store.upload_part(u, 3, b"late")
    v = store.create_upload("n")
    store.upload_part_copy(v, 1, "m", 0, 4)
    store.abort_upload(v)
    store.abort_upload(v)
    store.create_upload("old")
    before = store.bucket.rows("chunks").count()
    store.bucket.maintain(now=2**50, grace=0, upload_ttl=1000)
    assert store.get("m") == b"hello world" and store.uploads().count() == 0 and store.bucket.rows("chunks").count() < before
    assert len(store.bucket.snapshot().facts) == 1


def test_reads_are_right_or_fail(spark, tmp_path):
    import dataclasses

    store = Objects(Bucket(spark, str(tmp_path / "b"), 2), chunk=4)
    store.put("k", b"0123456789")
    chunks = store.bucket.rows("chunks").toPandas()
    good = store.bucket.snapshot()

    def with_chunks(rows):
        df = spark.createDataFrame([(r.blob, r.entry_id, r.crc, bytearray(r.data)) for r in rows.itertuples()], "blob long, entry_id long, crc long, data binary")
        name = store.bucket._write(df, "chunks", False)
        now = store.bucket.snapshot()
        store.bucket._publish(dataclasses.replace(good, version=now.version + 1, chunks=[name]))

    for k in range(3):
        with_chunks(chunks[chunks.entry_id != k])
        with pytest.raises(Exception, match="missing chunk"):
            store.get("k")
    with_chunks(chunks[chunks.entry_id != 2])
    assert store.get("k", 0, 5) == b"012345"
    bad = chunks.copy()
    bad["data"] = [b"012x" if e == 0 else d for e, d in zip(bad.entry_id, bad.data)]
    with_chunks(bad)
    with pytest.raises(Exception, match="damaged chunk"):
        store.get("k")
    short = chunks.copy()
    short["data"] = [d[:-1] for d in short.data]
    with_chunks(short)
    with pytest.raises(Exception, match="wrong length"):
        store.get("k")
    with_chunks(chunks[chunks.entry_id == 0])
    with pytest.raises(Exception, match="missing chunk"):
        store.get("k")


def test_snapshots_are_whole_and_exclusive(spark, tmp_path):
    import dataclasses

    from millrace.sources.store import Busy, Conflict

    b = Bucket(spark, str(tmp_path / "b"), 2, stall=2)
    store = Objects(b, chunk=4, most_uploads=1)
    store.put("a", b"1")
    (tmp_path / "b" / "snapshots" / "draft-of-a-dead-writer").write_text("{")
    assert b.snapshot().version == 1
    with pytest.raises(Conflict):
        b._publish(dataclasses.replace(b.snapshot()))
    store.put("a", b"2")
    with pytest.raises(Busy):
        store.put("a", b"3")
    old = b.snapshot()
    now = b.clock.wall()
    b.compact(now, 0)
    assert b.collect(now, 3_600_000) == 0 and b.log(version=old.version).count() == 2  # readers of the old version go on
    assert b.collect(now + 2 * 3_600_000, 3_600_000) >= 2 and store.get("a") == b"2"
    u = store.create_upload("m", "text/plain", {"k": "v"})
    with pytest.raises(Busy):
        store.create_upload("n")
    store.complete_upload(u, [(1, store.upload_part(u, 1, b"x"))])
    assert store.head("m").user_meta == {"k": "v"} and store.head("m").content_type == "text/plain"
    store.bucket.compact(now, 0)
    store.put_all(spark.createDataFrame([("t", bytearray(b"2"), "x", 2), ("t", bytearray(b"1"), "x", 1)], "key string, data binary, token string, seq long"))
    assert store.get("t") == b"1"
