"""Known cases: scans, deletions, copies, multipart, compaction, text formats, clocks, the store, streams."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys as K
from millrace.operators import access, blob, clock, cluster, compaction, metrics, mutations, resolve
from millrace.operators import scan as S
from millrace.sources.store import Bucket, Conflict
from millrace.streaming import windows

PUT, DEL = 1, 2
FACT = "key string, p long, l int, n int, type int, created_at long"


def facts(spark, rows):
    return spark.createDataFrame([(*r, 0)[:6] if len(r) < 6 else r for r in rows], FACT)


def ranges(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, e string, p long, l int, n int")


def puts(spark, keys):
    return facts(spark, [(k, i, 0, 0, PUT) for i, k in enumerate(keys.split())])


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], schema or "x int").select(column.alias("r")).first().r


def keys(df):
    return sorted(r.key for r in df.collect())


def test_prefix_and_pages(spark):
    view = puts(spark, "a/1 a/2 a/3 a/4 b/1")
    first = S.page(view, S.ScanQuery(prefix="a/", limit=2))
    assert [r.key for r in first.rows] == ["a/1", "a/2"] and first.next == "a/2"
    rest = S.page(view, S.ScanQuery(prefix="a/", after=first.next))
    assert [r.key for r in rest.rows] == ["a/3", "a/4"] and rest.next is None
    back = [[r.key for r in p.rows] for p in S.pages(view, S.ScanQuery(prefix="a/", reverse=True, limit=2))]
    assert back == [["a/4", "a/3"], ["a/2", "a/1"]]
    assert S.resume("a", S.token(first)) == "a/2" and S.resume("a") == "a" and S.decode_token(S.encode_token("ü/€")) == "ü/€"
    assert [S.page_size(x) for x in (None, "x", "0", "5", "9999")] == [1000, 1000, 1, 5, 1000] and S.dashboard_size(0) == 100


def test_windows(spark):
    view = puts(spark, "a b c d e c2")
    q = S.ScanQuery(start="b", end="e")
    assert [r.key for r in S.bounded(view, q).collect()] == ["b", "c", "c2", "d"]
    assert [r.key for r in S.bounded(view, S.ScanQuery(start="b", end="e", reverse=True)).collect()] == ["d", "c2", "c", "b"]
    assert keys(S.bounded(puts(spark, "p/a p/b p/c q/a"), S.ScanQuery(prefix="p/", start="p/b", end="p/c"))) == ["p/b"]
    assert keys(S.bounded(puts(spark, "a￿ a\U00010000 b"), S.ScanQuery(prefix="a", start="a￿￿"))) == ["a\U00010000"]


def test_scan_filters_reach_parquet(spark, tmp_path):
    puts(spark, "a b c").write.parquet(f"{tmp_path}/t")
    plan = S.bounded(resolve.live(spark.read.parquet(f"{tmp_path}/t")), S.ScanQuery(prefix="b", start="a"))._jdf.queryExecution().toString()
    assert "StringStartsWith(key,b)" in plan and "GreaterThanOrEqual(key,b)" in plan and "LessThan(key,c)" in plan and "TakeOrderedAndProject" in plan


def test_prefix_successor():
    assert K.prefix_successor(b"ab") == b"ac" and K.prefix_successor(b"\x01\xff\xff") == b"\x02"
    assert K.prefix_successor(b"") is None and K.prefix_successor(b"\xff\xff") is None


def test_last_writer_wins(spark):
    a = facts(spark, [("k", 5, 0, 0, PUT), ("t", 1, 0, 0, PUT), ("n", 1, 1, 1, PUT)])
    b = facts(spark, [("k", 4, 9, 9, DEL), ("t", 2, 0, 0, DEL), ("n", 1, 1, 2, PUT)])
    got = {r.key: (r.p, r.l, r.n, r.type) for r in resolve.merge(b, a).collect()}
    assert got == {"k": (5, 0, 0, PUT), "t": (2, 0, 0, DEL), "n": (1, 1, 2, PUT)}
    assert keys(resolve.live(a.union(b))) == ["k", "n"]


@pytest.mark.parametrize("few", [0, 100])
def test_range_deletes(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "BROADCAST_RANGES", few)
    f = puts(spark, "a b c d")
    assert keys(resolve.live(f, ranges(spark, ("b", "d", 9, 0, 0)))) == ["a", "d"]
    k = facts(spark, [("k", 1, 0, 0, PUT), ("k", 3, 0, 0, PUT)])
    assert keys(resolve.live(k, ranges(spark, ("k", "l", 2, 0, 0)))) == ["k"]
    assert keys(resolve.live(k, ranges(spark, ("k", "l", 3, 0, 0)))) == ["k"], "only strictly newer deletions hide"
    logs = puts(spark, "logs/1 logs/2 logz")
    assert keys(resolve.live(logs, mutations.delete_prefix("logs/", spark, 9, 0, 0))) == ["logz"]
    assert keys(resolve.live(logs, mutations.delete_prefix("", spark, 9, 0, 0))) == []
    assert keys(resolve.live(logs, ranges(spark, (None, "logs/2", 9, 0, 0), ("logz", None, 9, 0, 0)))) == ["logs/2"]
    with pytest.raises(ValueError):
        mutations.delete_range("b", "a", spark, 1, 0, 0)


def test_compaction(spark):
    f = facts(spark, [("a", 1, 0, 0, PUT, 1), ("k", 1, 0, 0, PUT, 1), ("z", 1, 0, 0, PUT, 1), ("k", 2, 0, 0, DEL, 1000)])
    none = ranges(spark).limit(0)
    assert keys(compaction.compact(f, none, True, 2000, 100)[0]) == ["a", "z"]
    assert keys(compaction.compact(f, none, True, 1050, 100)[0]) == ["a", "k", "z"]
    assert keys(compaction.compact(f, none, False, 2000, 100)[0]) == ["a", "k", "z"]
    p, r = puts(spark, "c z"), ranges(spark, ("b", "d", 1000, 0, 0))
    for now, bottom, left, kept in ((2000, True, ["z"], 0), (1050, True, ["c", "z"], 1), (2000, False, ["c", "z"], 1)):
        points, rest = compaction.compact(p, r, bottom, now, 100)
        assert keys(points) == left and rest.count() == kept


def test_picking_inputs(spark):
    t = spark.createDataFrame([(1, 0, "a", "f", 1, 5), (2, 0, "e", "k", 1, 5), (3, 1, "b", "c", 1, 5), (4, 1, "x", "z", 1, 5), (5, 2, "a", "z", 1, 5)], "ledger int, level int, min_key string, max_key string, entries int, bytes long")
    got, level, bottom = compaction.pick_inputs(t, trigger=2)
    assert sorted(x.ledger for x in got) == [1, 2, 3] and (level, bottom) == (1, False)
    got, level, bottom = compaction.pick_inputs(t, trigger=9, base=4, growth=10)
    assert sorted(x.ledger for x in got) == [3, 5] and (level, bottom) == (2, True)
    assert compaction.pick_inputs(t, trigger=9) is None and not compaction.stalled(t)


def test_checksums(spark):
    for f in (K.crc32c, K.crc32c_fast):
        df = spark.createDataFrame([("123456789",), ("",), (None,)], "s string").select(f(F.col("s")).alias("c"))
        assert [r.c for r in df.collect()] == [0xE3069283, 0, None]
    df = spark.createDataFrame([(f"key/{i}",) for i in range(200)], "k string").select("k", K.partition_of(F.col("k"), 8).alias("p"))
    rows = df.collect()
    assert {r.p for r in rows} == set(range(8)) and all(K.partition_of_key(r.k, 8) == r.p for r in rows) and K.partition_of_key("x", 1) == 0
    with pytest.raises(ValueError):
        K.partition_of_key("x", 0)
    K.register(spark)
    assert spark.sql("SELECT crc32c(CAST('123456789' AS BINARY)) AS c, etag(255) AS e, crc32c(CAST('' AS BINARY)) AS z").first() == (0xE3069283, "f".rjust(32, "0").replace("0f", "ff"), 0)


def test_text_functions(spark):
    assert one(spark, K.etag(F.lit(-1), F.lit(3))) == "f" * 8 if False else one(spark, K.etag(F.lit(-1), F.lit(3))) == "0" * 24 + "f" * 8 + "-3"
    assert one(spark, K.etag_crc(F.lit('"nonsense"'))) is None
    assert one(spark, K.percent_decode(F.lit("a%2Fb+c"))) == "a/b+c" and one(spark, K.percent_decode(F.lit("bad%zz"))) == "bad%zz" and one(spark, K.percent_decode(F.lit("%41%zz%4%%e4%C3%A4"))) == "A%zz%4%\ufffdä"
    assert one(spark, K.parse_grant(F.lit("User:x:read+ADMIN"))) == ("User:x", ["ADMIN", "READ"]) and one(spark, K.parse_grant(F.lit("x:FLY"))) is None and one(spark, K.parse_grant(F.lit("x:"))) is None
    assert one(spark, K.operation_permissions(K.permission_operations(F.lit("full_control")))) == ["FULL_CONTROL"] and one(spark, K.permission_operations(F.lit("x"))) is None
    assert one(spark, K.user_metadata(F.create_map(F.lit("X-Amz-Meta-Color"), F.lit("red"), F.lit("Host"), F.lit("h")))) == {"color": "red"}
    assert one(spark, K.unescape_label(K.escape_label(F.lit('a"b\\n\n')))) == 'a"b\\n\n'
    assert [one(spark, K.human_bytes(F.lit(x))) for x in (5, 1536, 20480, 500 * 1024**2)] == ["5 B", "1.50 KiB", "20.0 KiB", "500 MiB"]
    assert [one(spark, K.relative_age(F.lit(x), 10**12)) for x in (10**12 - 5000, 10**12 - 7200000, 0)] == ["5s ago", "2h ago", "—"]
    assert one(spark, K.human_count(F.lit(1234567))) == "1,234,567"
    assert [one(spark, K.valid_bucket(F.lit(x))) for x in ("abc", "a", "-ab", "a-b", "A-b")] == [True, False, False, True, False]


def test_prometheus_text(spark):
    body = '# c\na 1\nb{x="1",y="q\\"z"} 2.5 1700\nc{} 3e2\nn NaN\ni -Inf\n bad{ 1\n\nnovalue\n'
    got = metrics.samples(spark.createDataFrame([("t", 7, body)], "target string, t long, body string")).collect()
    assert [(r.name, r.labels, r.v, r.t) for r in got] == [("a", {}, 1.0, 7), ("b", {"x": "1", "y": 'q"z'}, 2.5, 7), ("c", {}, 300.0, 7)]
    assert metrics.window_seconds(60, 15000) == 900


def test_tokens_copies_and_acl(spark):
    req = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a"), (None, 3, "c"), (None, 4, "d")], "token string, seq int, v string")
    assert sorted(r.v for r in mutations.first_of_token(req).collect()) == ["a", "c", "d"]
    view = spark.createDataFrame([("s", 1, 0, 0, PUT, 5, "User:o", [("AllUsers", ["READ"])])], FACT + ", owner string, grants array<struct<grantee:string,ops:array<string>>>")
    pair = spark.createDataFrame([("s", "d"), ("s", "s"), ("absent", "x")], "src string, dst string")
    at = [F.lit(9).cast("long"), F.lit(0), F.lit(0), F.lit(77).cast("long")]
    new = mutations.copy(view, pair, *at).collect()
    assert [(r.key, r.created_at, r.grants, r.owner) for r in new] == [("d", 77, None, None)]
    moved = mutations.copy(view, pair, *at, rename=True).collect()
    assert sorted((r.key, r.type, r.l) for r in moved) == [("d", PUT, 0), ("s", DEL, 1)] and [r.grants for r in moved if r.key == "d"][0][0].grantee == "AllUsers"
    changed = mutations.set_grants(view, view.select("key", mutations.revoke(F.col("grants"), F.lit("AllUsers")).alias("new_grants")), *at[:3]).first()
    assert changed.grants == [] and changed.created_at == 5 and changed.p == 9
    may = access.authorized(F.col("owner"), F.array().cast("array<struct<grantee:string,ops:array<string>>>"), F.lit("User:x"), F.lit("READ"), object_grants=F.col("grants"))
    assert view.select(may.alias("m")).first().m is True
    assert not mutations.bucket_is_empty(view.select("key", "p", "l", "n", "type", "created_at"), ranges(spark).limit(0))


def test_multipart(spark):
    recorded = spark.createDataFrame([("u", 1, 1, 5, 7), ("u", 1, 2, 6, 8), ("u", 2, 3, 1, 9), ("u", 3, 4, 9, 9)], "upload_id string, part_number int, seq int, len long, crc long")
    latest = blob.latest_parts(recorded)
    assert latest.where("part_number = 1").first().len == 6

    def status(*listed):
        rows = [("u", i, n, c) for i, (n, c) in enumerate(listed)]
        return blob.complete(spark.createDataFrame(rows, "upload_id string, ord int, part_number int, crc long"), latest, 5).first()

    assert status((1, 8), (2, 9))[1:] == ("ok", 2, 7) and status((1, 8), (3, 9)).status == "ok", "a subset may be listed"
    assert status((2, 9), (1, 8)).status == "order" and status((1, 7)).status == "checksum" and status((1, 8), (4, 1)).status == "unknown part" and status((2, 9), (3, 9)).status == "too small"


def test_balancer(spark):
    parts = spark.createDataFrame([("b", k) for k in range(8)], "bucket string, part int")
    members = spark.createDataFrame([(1, ""), (2, "")], "node int, address string")
    leases = spark.createDataFrame([("b", k, 1) for k in range(7)] + [("b", 7, 9)], "bucket string, part int, node int")
    got = {r.part: r.node for r in cluster.balance(parts, members, leases, moves=2).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: 2}, "four stay, the dead member's goes, two move, the last waits"


def test_clock(spark):
    now = [100]
    c = clock.HybridClock(3, lambda: now[0], max_skew=50)
    assert c.tick() == (100, 0, 3) and c.tick() == (100, 1, 3)
    now[0] = 90
    assert c.tick(3) == (100, 2, 3) and c.tick() == (100, 5, 3)
    c.observe(120, 4)
    assert c.tick() == (120, 5, 3)
    with pytest.raises(ValueError):
        c.observe(141, 0)
    now[0] = 500
    rows = clock.stamp(spark.createDataFrame([(f"k{i:03}",) for i in range(50)], "key string"), c).orderBy("key").collect()
    assert [(r.p, r.l, r.n) for r in rows] == [(500, i, 3) for i in range(50)]


def test_store(spark, tmp_path):
    b = Bucket(spark, f"{tmp_path}/bucket", 4)
    put = lambda p, *ks: spark.createDataFrame([(k, p, 0, 0, PUT, p) for k in ks], FACT)
    assert b.commit(put(1, "a", "b", "c")) == 1 and b.commit(put(2, "b"), ranges=ranges(spark, ("c", "d", 3, 0, 0))) == 2
    assert keys(b.live()) == ["a", "b"] and keys(b.live(1)) == ["a", "b", "c"] and b.get("b").first().p == 2 and b.get("zz").isEmpty()
    plan = b.log("a")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "(part#" in plan
    old = b.snapshot()
    b._publish(dataclasses.replace(old, version=old.version + 1))
    with pytest.raises(Conflict):
        b._publish(dataclasses.replace(old, version=old.version + 1))
    orphan = b._write(put(9, "lost"), "facts", True)  # a crash before the snapshot is published
    assert orphan and keys(b.live()) == ["a", "b"]
    b.compact(10**6, 100)
    assert keys(b.live()) == ["a", "b"] and len(b.snapshot().facts) == 1 and b.collect() == 3 and keys(b.live()) == ["a", "b"]
    with pytest.raises(ValueError):
        b.commit(put(5, "x" * 2000))
    b.view("bucket_view")
    assert spark.sql("SELECT count(*) AS n FROM bucket_view").first().n == 2
    assert Bucket(spark, f"{tmp_path}/bucket", 4).clock.last >= (2, 0)


def test_stream_keeps_the_last_n(spark, tmp_path):
    schema = "name string, t long, id long, v double"
    for k, rows in enumerate(([("a", 5, 1, 1.0), ("b", 1, 1, 9.0), ("a", 9, 1, 2.0)], [("a", 7, 1, 3.0), ("a", 1, 1, 4.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = windows.last_n(windows.tail(spark, f"{tmp_path}/in", schema), 2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, n, k=k: df.write.mode("overwrite").parquet(f"{tmp_path}/out{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.name, r.t, r.place) for r in spark.read.parquet(f"{tmp_path}/out1").where("name = 'a'").orderBy("place").collect()] == [("a", 7, 1), ("a", 9, 2)]


def test_stream_upserts_do_not_depend_on_order(spark, tmp_path):
    for rows in ([("k", 5, 0, 0, PUT, 0), ("j", 1, 0, 0, PUT, 0)], [("k", 4, 0, 0, DEL, 0), ("j", 2, 0, 0, DEL, 0)]):
        spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    windows.upsert(stream, f"{tmp_path}/table", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.key: (r.p, r.type) for r in spark.read.parquet(f"{tmp_path}/table/batch=1").collect()}
    assert got == {"k": (5, PUT), "j": (2, DEL)}
