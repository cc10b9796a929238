"""Facts of a key space derived from the star-schema tables, in Spark and as SQL named table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import crc32c_table

CHUNK = 256
NOW = 1_800_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("p"), (F.col("event_id") % 4).cast("int").alias("l"),
        (F.col("user_id") % 3).cast("int").alias("n"), F.regexp_extract("props", "-?[0-9]+", 0).cast("int").alias("k"),
    )


def _user(c: str = "user_id"):
    return F.concat(F.lit("u/"), F.lpad(F.col(c).cast("string"), 5, "0"), F.lit("/"))


_RANGE = "event_type = 'signup' AND event_id % 100 < 10"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, p, l, n, type, len, event_id"""
    e = events(spark, sf_dir).where(f"NOT ({_RANGE})")
    return e.select(
        F.concat(_user(), (F.col("k") % 10).cast("string")).alias("key"), "p", "l", "n", F.when(F.col("event_type") == "error", 2).otherwise(1).alias("type"),
        F.round(F.col("value") * 100).cast("bigint").alias("len"), "event_id",
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(_RANGE).select(_user().alias("s"), F.concat(_user(), F.lit("5")).alias("e"), "p", "l", "n")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upload_id, part_number, seq, len, crc"""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("part_number"),
        ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("seq"),
        F.col("l_quantity").cast("bigint").alias("len"), (F.col("l_partkey") % 97).alias("crc"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upload_id, key, created_at"""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("upload_id"), F.concat(F.lower("o_orderpriority"), F.lit("/"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("key"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint").alias("created_at"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob, key, text of documents stored as objects"""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("blob"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("key"), "text")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger, level, min_key, max_key, entries, bytes"""
    o = table(spark, sf_dir, "orders").withColumn("ledger", F.floor(F.col("o_orderkey") / 500)).withColumn("key", F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    o = o.withColumns({"bytes": F.floor("o_totalprice").cast("bigint"), "blob": F.col("o_custkey") % 50})
    from ..operators.compaction import table_statistics

    return table_statistics(o, "ledger").withColumn("level", (F.col("ledger") % 3).cast("int"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ledger, blob"""
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("ledger"), (F.col("o_orderkey") * 31 % 6007).alias("blob")).distinct()


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.lower(F.col("n_name")).alias("bucket"), F.lit(8).alias("partition_count"), F.concat(F.lit("User:r"), F.col("n_regionkey").cast("string")).alias("owner"))


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    each = both.groupBy(F.lower("n_name").alias("bucket"), (F.col("s_suppkey") % 8).cast("int").alias("part"))
    return each.agg((F.min("s_suppkey") % 5).cast("int").alias("node"))


def members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f"10.0.0.{k}:9400") for k in range(4)], "node int, address string")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, owner, grants of customers as objects"""
    c = table(spark, sf_dir, "customer")
    read = lambda who: F.array(F.struct(F.lit(who).alias("grantee"), F.array(F.lit("READ")).alias("ops")))
    none = F.array().cast("array<struct<grantee:string,ops:array<string>>>")
    k = F.col("c_custkey") % 10
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("User:"), F.col("c_mktsegment"))).alias("owner"), F.when(k == 0, read("AllUsers")).when(k == 1, read("AuthenticatedUsers")).when(k == 2, read("User:BUILDING")).otherwise(none).alias("grants"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("p").alias("t"), F.col("event_id").alias("id"), F.col("value").alias("v"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS p, CAST(event_id % 4 AS INTEGER) AS l, CAST(user_id % 3 AS INTEGER) AS n, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k FROM events)"
USER = "'u/' || lpad(CAST(user_id AS VARCHAR), 5, '0') || '/'"
RT = f"rt AS (SELECT {USER} AS s, {USER} || '5' AS e, p, l, n FROM ev WHERE event_type = 'signup' AND event_id % 100 < 10)"
MUT = f"mut AS (SELECT {USER} || CAST(k % 10 AS VARCHAR) AS key, p, l, n, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS type, CAST(round(value * 100) AS BIGINT) AS len, event_id FROM ev WHERE NOT (event_type = 'signup' AND event_id % 100 < 10))"
WIN = "win AS (SELECT key, w.p AS p, w.l AS l, w.n AS n, w.type AS type, w.len AS len, w.event_id AS event_id FROM (SELECT key, max(struct_pack(p := p, l := l, n := n, type := type, len := len, event_id := event_id)) AS w FROM mut GROUP BY key))"
NEWER = "(rt.p > x.p OR (rt.p = x.p AND (rt.l > x.l OR (rt.l = x.l AND rt.n > x.n))))"
HIDDEN = f"EXISTS (SELECT 1 FROM rt WHERE rt.s <= x.key AND x.key < rt.e AND {NEWER})"
LIVE = f"live AS (SELECT * FROM win x WHERE type = 1 AND NOT {HIDDEN})"
KEYSPACE = f"WITH {EV}, {RT}, {MUT}, {WIN}, {LIVE} "
PARTS = "parts AS (SELECT l_orderkey AS upload_id, l_linenumber AS part_number, (l_partkey * 1000 + l_suppkey) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq, CAST(l_quantity AS BIGINT) AS len, l_partkey % 97 AS crc FROM lineitem), latest AS (SELECT upload_id, part_number, max(seq) AS seq, arg_max(len, seq) AS len, arg_max(crc, seq) AS crc FROM parts GROUP BY ALL)"
PARTS = PARTS.replace("GROUP BY ALL", "GROUP BY upload_id, part_number")
OBJECTS = "obj AS (SELECT doc_id AS blob, concat_ws('/', lang, source, CAST(doc_id AS VARCHAR)) AS key, hex(encode(text)) AS h FROM documents)"
TABLES = "tabs AS (SELECT o_orderkey // 500 AS ledger, CAST((o_orderkey // 500) % 3 AS INTEGER) AS level, min(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS min_key, max(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS max_key, count(*) AS entries, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, count(DISTINCT o_custkey % 50) AS blobs FROM orders GROUP BY 1, 2)"
REFS = "refs AS (SELECT DISTINCT o_orderkey // 500 AS ledger, o_orderkey * 31 % 6007 AS blob FROM orders)"
BUCKETS = "bk AS (SELECT lower(n_name) AS bucket, 8 AS partition_count, 'User:r' || CAST(n_regionkey AS VARCHAR) AS owner FROM nation)"
LEASES = "le AS (SELECT lower(n_name) AS bucket, CAST(s_suppkey % 8 AS INTEGER) AS part, CAST(min(s_suppkey) % 5 AS INTEGER) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"
RULES = "ru AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN 'User:' || c_mktsegment END AS owner, CASE c_custkey % 10 WHEN 0 THEN 'AllUsers' WHEN 1 THEN 'AuthenticatedUsers' WHEN 2 THEN 'User:BUILDING' END AS reader FROM customer)"
_TABLE = "[" + ",".join(map(str, crc32c_table())) + "]"


def crc_sql(key: str) -> str:
    """CRC-32C of an ASCII text in DuckDB."""
    octets = f"list_transform(range(1, length({key}) + 1), lambda i: CAST(ord(substr({key}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda s, b: xor(s >> 8, CAST({_TABLE}[(xor(s, b) & 255) + 1] AS BIGINT))), 4294967295)"
