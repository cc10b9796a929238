"""Queries over a bucket on disk, upkeep, limits, streams and polls; each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import blob, cluster, compaction, listing, metrics, mutations, resolve
from ..operators import clock as C
from ..operators import scan as S
from ..sources import scrape
from ..sources.scratch import folder
from ..sources.store import Bucket
from ..streaming import windows
from . import fixtures as X
from .catalog import live, query

FACT = "key string, p bigint, l int, n int, type int, len bigint, event_id bigint"


def bucket(s, d, commits: int = 3) -> Bucket:
    """All facts and range deletions of the fixtures in a new bucket, by so many commits."""
    b = Bucket(s, f"{folder(s)}/bucket", 4)
    f = X.facts(s, d).withColumn("created_at", F.floor(F.col("p") / 1000))
    for k in range(commits):
        b.commit(f.where(F.col("event_id") % commits == k), **({"ranges": X.ranges(s, d)} if k == 0 else {}))
    return b


# ---- a bucket on disk


@query(X.KEYSPACE + "SELECT key, p, l, n, type FROM mut")
def store_log(s, d):
    """Facts flushed by several commits, read back through the newest snapshot."""
    return bucket(s, d).log().select("key", "p", "l", "n", "type")


@query(X.KEYSPACE + "SELECT key, p, l, n FROM live")
def store_live(s, d):
    return bucket(s, d).live().select("key", "p", "l", "n")


@query(X.KEYSPACE + "SELECT key, p, l, n FROM live")
def store_compacted_live(s, d):
    """A compaction swaps all files for one; the live view stays."""
    b = bucket(s, d)
    b.compact(b.clock.wall(), 2**50)
    assert len(b.snapshot().facts) == 1
    return b.live().select("key", "p", "l", "n")


@query(X.KEYSPACE + "SELECT key, p, l, n FROM live")
def store_maintained_live(s, d):
    """Bounded upkeep: compaction, uploads, orphans, collection of what has been obsolete long enough."""
    b = bucket(s, d)
    b.maintain(b.clock.wall(), 2**50, 2**50)
    return b.live().select("key", "p", "l", "n")


@query(X.KEYSPACE + "SELECT key, p, l, n FROM live WHERE key = (SELECT max(key) FROM live)")
def store_point_read(s, d):
    """One key: its hash partition alone is read, row groups by statistics and Bloom filter."""
    b = bucket(s, d)
    return b.get(b.live().agg(F.max("key")).first()[0]).select("key", "p", "l", "n")


@query(X.KEYSPACE + "SELECT w.p AS p, w.l AS l FROM (SELECT max(struct_pack(p := p, l := l, n := n)) AS w FROM (SELECT p, l, n FROM mut UNION ALL SELECT p, l, n FROM rt))")
def store_recovered_clock(s, d):
    """A bucket opened again goes on from the greatest clock it finds."""
    b = bucket(s, d)
    again = Bucket(s, b.path, 4, max_skew=2**62)  # clocks of the fixtures are in microseconds
    return s.createDataFrame([again.clock.last], "p long, l int")


@query(X.KEYSPACE + "SELECT 'all' AS what, NOT EXISTS (SELECT 1 FROM live) AS gone UNION ALL SELECT 'deleted', true UNION ALL SELECT 'covered', true")
def drop_bucket_check(s, d):
    """Whether a bucket may be dropped without force: of all facts, of tombstones alone, and beneath a deletion of everything."""
    f, r = X.facts(s, d), X.ranges(s, d)
    over = mutations.delete_range(None, None, s, 2**60, 0, 0)
    rows = [("all", mutations.bucket_is_empty(f, r)), ("deleted", mutations.bucket_is_empty(f.where("type = 2"), r)), ("covered", mutations.bucket_is_empty(f, r.unionByName(over)))]
    return s.createDataFrame(rows, "what string, gone boolean")


@query(f"WITH {X.TABLES} SELECT ledger % 5 AS part, count(*) FILTER (level = 0) AS files, count(*) FILTER (level = 0) >= 2 AS stalled FROM tabs GROUP BY 1")
def write_stall(s, d):
    return compaction.level_stalled(X.tables(s, d).withColumn("part", F.col("ledger") % 5), "part", 2)


@query(f"WITH {X.TABLES} SELECT min(min_key) AS low, max(max_key) AS high FROM tabs WHERE level = 1")
def level_hull(s, d):
    return compaction.hull(X.tables(s, d), 1)


# ---- writes


@query(X.KEYSPACE + "SELECT key, len FROM live WHERE event_id % 3 <> 0")
def delete_put(s, d):
    """Tombstones for keys that are there and keys that are not."""
    view, log = live(s, d), X.facts(s, d)
    keys = view.where("event_id % 3 = 0").select("key").union(view.select(F.concat(F.lit("absent/"), "key")))
    gone = mutations.delete(keys.toDF("key"), F.lit(2**60).cast("bigint"), F.lit(0), F.lit(0), log.columns)
    return resolve.live(log.unionByName(gone), X.ranges(s, d)).select("key", "len")


@query(X.KEYSPACE + "SELECT key, CASE WHEN event_id % 2 = 0 THEN 1152921504606846976 ELSE p END AS p, p // 1000 AS created_at, CASE WHEN event_id % 2 = 0 THEN 'User:a:READ' ELSE '' END AS grants FROM live")
def set_acl(s, d):
    """New grants for half of the objects: new clock, same creation time and bytes."""
    none = F.array().cast("array<struct<grantee:string,ops:array<string>>>")
    log = X.facts(s, d).withColumns({"created_at": F.floor(F.col("p") / 1000), "grants": none})
    view = resolve.live(log, X.ranges(s, d))
    change = view.where("event_id % 2 = 0").select("key", F.array(F.struct(F.lit("User:a").alias("grantee"), F.array(F.lit("READ")).alias("ops"))).alias("new_grants"))
    new = mutations.set_grants(view, change, F.lit(2**60).cast("bigint"), F.lit(0), F.lit(0))
    out = resolve.live(log.unionByName(new), X.ranges(s, d))
    return out.select("key", "p", "created_at", F.array_join(F.transform("grants", K.format_grant), ";").alias("grants"))


@query(X.KEYSPACE + "SELECT key, owner, grants FROM (SELECT key, event_id, 'User:' || (event_id % 3) AS owner, CASE WHEN event_id % 2 = 0 THEN 'User:a:READ' ELSE '' END AS grants FROM live)")
def object_acl(s, d):
    """Owner and grants of every live object, as text."""
    none = F.array().cast("array<struct<grantee:string,ops:array<string>>>")
    some = F.array(F.struct(F.lit("User:a").alias("grantee"), F.array(F.lit("READ")).alias("ops")))
    view = live(s, d)
    return view.select("key", F.concat(F.lit("User:"), (F.col("event_id") % 3).cast("string")).alias("owner"), F.array_join(F.transform(F.when(F.col("event_id") % 2 == 0, some).otherwise(none), K.format_grant), ";").alias("grants"))


@query(f"WITH {X.BUCKETS}, {X.LEASES} SELECT bk.bucket AS bucket, bk.owner AS owner, bk.partition_count AS partition_count, count(le.part) AS held FROM bk LEFT JOIN le ON le.bucket = bk.bucket GROUP BY ALL")
def head_bucket(s, d):
    """What is known of each bucket: owner, partitions, and how many of them are held."""
    n = X.leases(s, d).groupBy("bucket").agg(F.count("*").alias("held"))
    return X.buckets(s, d).join(n, "bucket", "left").select("bucket", "owner", "partition_count", F.coalesce("held", F.lit(0)).alias("held"))


@query(
    "WITH u AS (SELECT o_orderkey AS upload_id, o_custkey % 50 AS bucket, o_orderpriority AS meta FROM orders), f AS (SELECT bucket, count(*) AS n FROM u WHERE upload_id % 4 = 0 GROUP BY 1), "
    "r AS (SELECT u.*, coalesce(f.n, 0) AS n, row_number() OVER (PARTITION BY u.bucket ORDER BY upload_id) AS k FROM u LEFT JOIN f ON f.bucket = u.bucket WHERE upload_id % 4 <> 0) SELECT upload_id, meta, CASE WHEN k + n <= 20 THEN 'ok' ELSE 'busy' END AS status FROM r"
)
def create_uploads(s, d):
    """Uploads asked for beside those in flight, at most 20 a bucket; metadata is kept."""
    u = X.table(s, d, "orders").select(F.col("o_orderkey").alias("upload_id"), (F.col("o_custkey") % 50).alias("bucket"), F.col("o_orderpriority").alias("meta"))
    return mutations.admit_uploads(u.where("upload_id % 4 <> 0"), u.where("upload_id % 4 = 0"), 20).select("upload_id", "meta", "status")


@query(f"WITH {X.OBJECTS} SELECT blob AS upload_id, 3 AS part_number, least(length(h) // 2, 701) - 100 AS len, md5(substr(h, 201, 1202)) AS hex_md5 FROM obj WHERE length(h) // 2 > 100")
def upload_part_copy(s, d):
    """The bytes 100 to 700 of every object that has them as part 3 of an upload: copied, not shared."""
    o = X.objects(s, d)
    low, high = blob.resolve_range(F.lit(100).cast("bigint"), F.lit(700).cast("bigint"), F.octet_length("text").cast("bigint"))
    want = o.select("blob", low.alias("from"), high.alias("to")).where(F.col("from").isNotNull())
    data = blob.read_range(blob.chunks(o, "blob", "text", X.CHUNK), want, X.CHUNK)
    part = data.select(F.col("blob").alias("upload_id"), F.lit(3).alias("part_number"), F.octet_length("data").cast("bigint").alias("len"), "data")
    copied = blob.chunks(part, "upload_id", "data", 64)
    whole = blob.reassemble(copied).select(F.col("blob").alias("upload_id"), F.md5(F.hex("data")).alias("hex_md5"))
    return part.drop("data").join(whole, "upload_id")


@query("SELECT event_id, 'error' AS status FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('k', CAST(1000 + event_id % 50 AS INTEGER)) ELSE 'a/' || event_id END AS k FROM events) WHERE k = '' OR length(k) > 1024")
def batch_delete_quiet(s, d):
    e = X.table(s, d, "events")
    key = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.repeat(F.lit("k"), (F.col("event_id") % 50 + 1000).cast("int"))).otherwise(F.concat(F.lit("a/"), F.col("event_id").cast("string")))
    return mutations.batch_delete(e.select("event_id", key.alias("key")), quiet=True).drop("key")


@query(X.KEYSPACE + "SELECT key, CAST(1800000000000 AS BIGINT) AS p, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS l, 3 AS n FROM (SELECT DISTINCT key FROM mut)")
def clock_stamps(s, d):
    """A batch of keys stamped by one tick of a clock whose wall clock stands."""
    c = C.HybridClock(3, wall=lambda: X.NOW)
    return C.stamp(X.facts(s, d).select("key").distinct(), c).select("key", "p", "l", "n")


@query(X.KEYSPACE + "SELECT key, p, l, n, type, len FROM win")
def late_upserts(s, d):
    """Four batches in an order of their own, merged one after the other: the clock decides, not the arrival."""
    f = X.facts(s, d)
    have = None
    for k in (2, 0, 3, 1):
        new = resolve.lww(f.where(F.col("event_id") % 4 == k))
        have = new if have is None else resolve.lww(have.unionByName(new))
    return have.select("key", "p", "l", "n", "type", "len")


# ---- listings


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1000 WHEN 1 THEN 1000 WHEN 2 THEN 1 WHEN 3 THEN least(event_id, 1000) ELSE 1000 END AS page, CASE event_id % 5 WHEN 0 THEN 1000 WHEN 2 THEN 1000 WHEN 3 THEN CASE WHEN event_id < 1 THEN 1000 ELSE least(event_id, 1000) END WHEN 4 THEN 1000 END AS uploads FROM events")
def page_sizes(s, d):
    """Page sizes asked for: missing, no number, less than 1, a number, too large."""
    i = F.col("event_id")
    k = i % 5
    text = F.when(k == 1, "many").when(k == 2, "-5").when(k == 3, i.cast("string")).when(k == 4, "99999")
    return X.table(s, d, "events").select("event_id", S.clamped(text).cast("bigint").alias("page"), S.clamped(text, uploads=True).cast("bigint").alias("uploads"))


@query("SELECT event_id, CASE WHEN event_id BETWEEN 1 AND 1000 THEN event_id ELSE 100 END AS page FROM events")
def dashboard_page_sizes(s, d):
    return X.table(s, d, "events").select("event_id", S.dashboard_clamped(F.col("event_id")).alias("page"))


@query(
    "WITH k AS (SELECT split_part(url, '//', 2) AS key FROM pages), e AS (SELECT CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) ELSE key END AS entry, instr(key, '/') > 0 AS is_prefix FROM k GROUP BY ALL), "
    "m AS (SELECT min(entry) AS marker FROM e WHERE is_prefix) SELECT entry, is_prefix, CASE WHEN NOT is_prefix THEN 'null' END AS version_id, CASE WHEN NOT is_prefix THEN true END AS is_latest FROM e, m WHERE entry > marker AND NOT starts_with(entry, marker) ORDER BY entry LIMIT 20"
)
def list_versions_page(s, d):
    """A page of versions rolled up at the delimiter, after a common prefix as marker."""
    k = X.table(s, d, "pages").select(F.split_part("url", F.lit("//"), F.lit(2)).alias("key"))
    first = listing.version_page(k, delimiter="/").where("is_prefix").agg(F.min("entry")).first()[0]
    return listing.version_page(k, delimiter="/", key_marker=first, limit=20)


@query(X.KEYSPACE + "SELECT '<Contents>' || chr(10) || '    <key>' || key || '&amp;</key>' || chr(10) || '    <len>' || CAST(len AS VARCHAR) || '</len>' || chr(10) || '</Contents>' AS line FROM live")
def list_xml(s, d):
    return listing.as_xml(live(s, d).select(F.concat("key", F.lit("&")).alias("key"), "len"))


@query("SELECT event_id, 'Ab' AS k, event_type AS v FROM events UNION ALL SELECT event_id, 'user' AS k, CAST(user_id AS VARCHAR) AS v FROM events")
def user_metadata(s, d):
    """Headers with the prefix, in any case, without it and in lower case; others stay out."""
    e = X.table(s, d, "events")
    headers = F.create_map(F.lit("X-Amz-Meta-AB"), F.col("event_type"), F.lit("x-amz-meta-User"), F.col("user_id").cast("string"), F.lit("Content-Type"), F.lit("text/plain"))
    out = e.select("event_id", F.explode(K.user_metadata(headers)).alias("k", "v"))
    return out.withColumn("k", F.when(F.col("k") == "ab", "Ab").otherwise(F.col("k")))


# ---- counters, polls, streams

OPS = ["put", "get", "delete", "scan", "list", "head", "copy", "rename"]


@query("SELECT user_id % 8 AS part, " + ", ".join(f"count(*) FILTER (event_id % 8 = {k}) AS n_{x}" for k, x in enumerate(OPS)) + " FROM events GROUP BY 1")
def engine_counters_all(s, d):
    """All eight operations of an engine, by partition."""
    e = X.table(s, d, "events").withColumn("part", F.col("user_id") % 8)
    op = F.get(F.array(*map(F.lit, OPS)), (F.col("event_id") % 8).cast("int"))
    return cluster.counters(e, op, "part", OPS).withColumnsRenamed({x: f"n_{x}" for x in OPS})


@query("SELECT event_id, 60 * event_id / 1000.0 AS seconds FROM events")
def window_lengths(s, d):
    """Seconds that 60 samples span at each interval of milliseconds."""
    return X.table(s, d, "events").select("event_id", metrics.window_seconds(60, F.col("event_id")).alias("seconds"))


@query("SELECT CAST(1800000000000 AS BIGINT) AS t, 'up' AS name, event_type AS kind, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY event_type UNION ALL SELECT 1800000000000, 'failed', 'one', 1.0")
def metrics_scrape(s, d):
    """Two targets are polled, one of which is not there; samples take the time of the poll."""
    n = X.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    at = f"{folder(s)}/metrics"
    lines = metrics.exposition(n.withColumnRenamed("event_type", "kind"), F.lit("up"), ["kind"], F.col("n"))
    lines.coalesce(1).write.text(at)
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    part = next(f.getPath().toUri().getPath() for f in files if f.getPath().getName().startswith("part-"))
    got = scrape.scrape(s, [f"file://{part}", f"file://{part}.absent"], t=X.NOW)
    failed = got.where("error is not null").groupBy("t").agg(F.count("*").cast("double").alias("v"))
    up = metrics.samples(got.where("error is null")).select("t", "name", F.col("labels")["kind"].alias("kind"), "v")
    return up.union(failed.select("t", F.lit("failed"), F.lit("one"), "v"))


@query("SELECT DISTINCT user_id || event_type AS token FROM events")
def stream_token_dedup(s, d):
    """Requests as a stream, each token once within the time kept."""
    at, name = folder(s), f"tokens_{uuid.uuid4().hex}"
    X.table(s, d, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("token"), F.col("ts").cast("timestamp").alias("t")).write.parquet(f"{at}/in")
    stream = windows.tail(s, f"{at}/in", "token string, t timestamp")
    kept = windows.first_of_tokens(stream, "t", "3650 days").select("token")
    kept.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("token string").parquet(f"{at}/out")


@query(X.KEYSPACE + "SELECT key, p, l, n, type, len FROM win")
def stream_upserts(s, d):
    """Facts as a stream of batches, appended and merged on reading."""
    at = folder(s)
    X.facts(s, d).repartition(3).write.parquet(f"{at}/in")
    stream = s.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    windows.append_upserts(stream, f"{at}/table", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return windows.current(s, f"{at}/table", FACT).select("key", "p", "l", "n", "type", "len")


@query("SELECT name, t, id, v, row_number() OVER (PARTITION BY name ORDER BY t, id) AS place FROM (SELECT event_type AS name, epoch_us(ts) AS t, event_id AS id, value AS v FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 60)")
def stream_last_n(s, d):
    """Samples as a stream of batches; the last batch that touched a name holds its window."""
    at = folder(s)
    X.samples(s, d).repartition(2).write.parquet(f"{at}/in")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = s.readStream.schema("name string, t long, id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    windows.last_n(stream).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = s.read.parquet(f"{at}/out")
    newest = out.groupBy("name").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["name", "batch"]).select("name", "t", "id", "v", F.col("place").cast("bigint").alias("place"))
