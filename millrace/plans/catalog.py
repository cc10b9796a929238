"""Queries by name, each with the SQL that must give the same rows. Every query runs over its whole tables; a limit stands
only where the page is what is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import access, blob, cluster, compaction, listing, metrics, mutations, resolve
from ..operators import scan as S
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def live(s: SparkSession, d: str) -> DataFrame:
    return resolve.live(X.facts(s, d), X.ranges(s, d))


ROW = ("key", "p", "l", "n", "len")


# ---- last writer wins, deletions


@query(X.KEYSPACE + "SELECT key, p, l, n, len FROM live")
def live_view(s, d):
    return live(s, d).select(*ROW)


@query(X.KEYSPACE + "SELECT key, p, l, n, type, len FROM win")
def lww_winners_with_tombstones(s, d):
    return resolve.lww(X.facts(s, d)).select("key", "p", "l", "n", "type", "len")


@query(X.KEYSPACE + "SELECT key, p, l, n, type, len FROM win")
def merge_sources(s, d):
    """Facts held in three overlapping sources merge to the same winners."""
    f = X.facts(s, d)
    return resolve.merge(f.where("event_id % 3 = 0"), f.where("event_id % 3 = 1"), f.where("event_id % 3 <> 0")).select("key", "p", "l", "n", "type", "len")


@query(X.KEYSPACE + "SELECT key, p FROM win WHERE type = 2")
def point_tombstones(s, d):
    return resolve.lww(X.facts(s, d)).where(F.col("type") == resolve.DELETE).select("key", "p")


@query(X.KEYSPACE + f"SELECT key, p FROM win x WHERE type = 1 AND {X.HIDDEN}")
def shadowed_keys(s, d):
    return resolve.shadowed(resolve.lww(X.facts(s, d)).where("type = 1"), X.ranges(s, d)).select("key", "p")


@query(X.KEYSPACE + "SELECT key, w.p AS cp, w.l AS cl, w.n AS cn FROM (SELECT x.key AS key, max(struct_pack(p := rt.p, l := rt.l, n := rt.n)) AS w FROM win x JOIN rt ON rt.s <= x.key AND x.key < rt.e GROUP BY x.key)")
def max_covering_tombstone(s, d):
    return resolve.max_covering(X.facts(s, d), X.ranges(s, d))


@query(X.KEYSPACE + "SELECT w.p AS p, w.l AS l, w.n AS n FROM (SELECT max(struct_pack(p := p, l := l, n := n)) AS w FROM (SELECT p, l, n FROM mut UNION ALL SELECT p, l, n FROM rt))")
def log_max_clock(s, d):
    return resolve.max_clock(X.facts(s, d), X.ranges(s, d))


@query(X.KEYSPACE + "SELECT key, p, l, n, len FROM live WHERE key = (SELECT min(key) FROM live)")
def point_get(s, d):
    """Resolves one key: the filter is pushed below the merge to the scan."""
    first = live(s, d).agg(F.min("key")).first()[0]
    return resolve.live(X.facts(s, d).where(F.col("key") == first), X.ranges(s, d)).select(*ROW)


# ---- ordered scans


def _page(s, d, **q) -> DataFrame:
    return S.bounded(live(s, d), S.ScanQuery(**q)).select(*ROW)


_PAGE = X.KEYSPACE + "SELECT key, p, l, n, len FROM live WHERE {} ORDER BY key {} LIMIT {}"


@query(_PAGE.format("key >= 'u/00040'", "", 50))
def scan_forward(s, d):
    return _page(s, d, start="u/00040", limit=50)


@query(_PAGE.format("true", "DESC", 50))
def scan_reverse(s, d):
    return _page(s, d, reverse=True, limit=50)


@query(_PAGE.format("key >= 'u/00010/' AND key < 'u/00090/'", "DESC", 25))
def scan_window(s, d):
    return _page(s, d, start="u/00010/", end="u/00090/", reverse=True, limit=25)


@query(_PAGE.format("starts_with(key, 'u/0002')", "", 1000))
def scan_prefix(s, d):
    return _page(s, d, prefix="u/0002")


@query(_PAGE.format("starts_with(key, 'u/0003') AND key >= 'u/00032' AND key < 'u/00037/4'", "", 1000))
def scan_prefix_window(s, d):
    return _page(s, d, prefix="u/0003", start="u/00032", end="u/00037/4")


@query(_PAGE.format("key > 'u/00050/3'", "", 20))
def scan_cursor_fwd(s, d):
    return _page(s, d, after="u/00050/3", limit=20)


@query(_PAGE.format("key < 'u/00050/3'", "DESC", 20))
def scan_cursor_rev(s, d):
    return _page(s, d, after="u/00050/3", reverse=True, limit=20)


@query(X.KEYSPACE + "SELECT key, p, l, n, len FROM live ORDER BY key")
def scan_all(s, d):
    return S.scan(live(s, d), S.ScanQuery()).select(*ROW)


@query(X.KEYSPACE + "SELECT key, CAST(ceil(row_number() OVER (ORDER BY key) / 100.0) AS BIGINT) AS page FROM live")
def scan_pages(s, d):
    """All pages of 100 keys, numbered in one plan."""
    return S.paged(live(s, d).select("key"), 100)


@query(X.KEYSPACE + "SELECT key, p, l, n, len FROM live ORDER BY key LIMIT 100")
def scatter_gather_page(s, d):
    """A page gathered from the pages of all partitions: each task keeps its first rows, one merges them."""
    return live(s, d).orderBy("key").limit(100).select(*ROW)


@query(X.KEYSPACE + "SELECT key, len FROM live ORDER BY len DESC NULLS LAST, key LIMIT 30")
def dashboard_sort(s, d):
    return live(s, d).orderBy(F.col("len").desc_nulls_last(), "key").limit(30).select("key", "len")


# ---- listings


@query("WITH k AS (SELECT split_part(url, '//', 2) AS key FROM pages) SELECT CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) ELSE key END AS entry, instr(key, '/') > 0 AS is_prefix, count(*) AS n FROM k GROUP BY 1, 2")
def list_delimiter(s, d):
    k = X.table(s, d, "pages").select(F.split_part("url", F.lit("//"), F.lit(2)).alias("key"))
    return listing.roll_up(k)


@query(X.KEYSPACE + "SELECT substr(key, 1, 8) AS entry, true AS is_prefix, count(*) AS n, CAST(sum(len) AS BIGINT) AS len FROM live WHERE starts_with(key, 'u/') GROUP BY 1")
def list_delimiter_counts(s, d):
    return listing.roll_up(live(s, d), "u/", size="len")


@query(X.KEYSPACE + "SELECT key, p, 'null' AS version_id, true AS is_latest FROM live")
def list_versions(s, d):
    return listing.versions(live(s, d)).select("key", "p", "version_id", "is_latest")


_UPLOADS = "up AS (SELECT o_orderkey AS upload_id, lower(o_orderpriority) || '/' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS key, epoch_us(o_orderdate) // 1000 AS created_at FROM orders)"


@query(f"WITH {_UPLOADS} SELECT upload_id, key, created_at FROM up WHERE starts_with(key, '2') AND (key > '2-high/000500' OR (key = '2-high/000500' AND upload_id > 100)) ORDER BY key, upload_id LIMIT 200")
def list_uploads(s, d):
    return listing.uploads(X.uploads(s, d), "2", "2-high/000500", 100, 200)


@query(f"WITH {_UPLOADS} SELECT upload_id, key, created_at FROM up ORDER BY key, upload_id LIMIT 150")
def list_uploads_merged(s, d):
    u = X.uploads(s, d)
    return listing.merged_uploads(*[u.where(F.col("upload_id") % 3 == k) for k in range(3)], limit=150)


@query(f"WITH {X.PARTS} SELECT upload_id, part_number, len FROM latest WHERE upload_id = 7 AND part_number > 1 ORDER BY part_number LIMIT 1000")
def list_parts(s, d):
    return listing.parts(blob.latest_parts(X.parts(s, d)), 7, 1).select("upload_id", "part_number", "len")


@query(X.KEYSPACE + "SELECT key || chr(9) || CAST(len AS VARCHAR) || chr(9) || CAST(p AS VARCHAR) AS line FROM live")
def list_tsv(s, d):
    return listing.as_tsv(live(s, d).select("key", "len", "p"))


@query(X.KEYSPACE + """SELECT '{"key":"' || key || '","len":' || CAST(len AS VARCHAR) || '}' AS line FROM live""")
def list_json(s, d):
    return listing.as_json(live(s, d).select("key", "len"))


# ---- hashing, partitions, tags


@query(X.KEYSPACE + f", c AS (SELECT key, {X.crc_sql('key')} AS crc FROM win) SELECT key, CAST(crc AS BIGINT) AS crc, CAST((crc & 2147483647) % 8 AS INTEGER) AS part FROM c")
def partition_of_key(s, d):
    k = X.facts(s, d).select("key").distinct()
    return k.select("key", K.crc32c(F.col("key")).alias("crc"), K.partition_of(F.col("key"), 8).alias("part"))


@query(f"WITH k AS (SELECT DISTINCT 'u/' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key FROM events) SELECT CAST(({X.crc_sql('key')} & 2147483647) % 8 AS INTEGER) AS part, count(*) AS n FROM k GROUP BY 1")
def partition_histogram(s, d):
    k = X.table(s, d, "events").select(F.concat(F.lit("u/"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("key")).distinct()
    return k.groupBy(K.partition_of(F.col("key"), 8).alias("part")).agg(F.count("*").alias("n"))


@query(X.KEYSPACE + f", c AS (SELECT key, {X.crc_sql('key')} AS crc FROM win) SELECT key, lpad(lower(to_hex(CAST(crc AS BIGINT))), 32, '0') AS etag, CAST(crc AS BIGINT) AS crc FROM c")
def etag_hex(s, d):
    k = X.facts(s, d).select("key").distinct()
    tag = K.etag(K.crc32c_fast(F.col("key")))
    return k.select("key", tag.alias("etag")).select("key", "etag", K.etag_crc(F.concat(F.lit('"'), "etag", F.lit('-3"'))).alias("crc"))


@query(X.KEYSPACE + "SELECT key, rtrim(translate(to_base64(encode(key)), '+/', '-_'), '=') AS token, key AS back FROM live")
def continuation_tokens(s, d):
    t = live(s, d).select("key", K.base64url(F.col("key")).alias("token"))
    return t.withColumn("back", K.base64url_text(F.col("token")))


# ---- blobs, ranges, multipart


@query(f"WITH {X.OBJECTS}, c AS (SELECT blob, length(h) // 2 AS n, h, unnest(range(0, length(h) // 2, {X.CHUNK})) AS a FROM obj WHERE length(h) > 0) SELECT blob, a // {X.CHUNK} AS entry_id, a AS at, least({X.CHUNK}, n - a) AS len FROM c")
def chunk_layout(s, d):
    return blob.chunk_layout(X.objects(s, d), "blob", F.octet_length("text"), X.CHUNK)


@query(f"WITH {X.OBJECTS}, c AS (SELECT blob, h, unnest(range(0, length(h) // 2, {X.CHUNK})) AS a FROM obj WHERE length(h) > 0) SELECT blob, CAST(a // {X.CHUNK} AS INTEGER) AS entry_id, md5(substr(h, 2 * a + 1, {2 * X.CHUNK})) AS hex_md5 FROM c")
def chunk_bytes(s, d):
    c = blob.chunks(X.objects(s, d), "blob", "text", X.CHUNK)
    return c.select("blob", "entry_id", F.md5(F.hex("data")).alias("hex_md5"))


@query(f"WITH {X.OBJECTS}, c AS (SELECT blob, unnest(range(0, length(h) // 2, {X.CHUNK})) // {X.CHUNK} AS e FROM obj WHERE length(h) > 0) SELECT blob, e // 4 AS segment, CAST(min(e) AS INTEGER) AS first, CAST(max(e) AS INTEGER) AS last FROM c GROUP BY 1, 2")
def blob_segments(s, d):
    return blob.segments(blob.chunks(X.objects(s, d), "blob", "text", X.CHUNK, checksums=False), 4)


@query("SELECT doc_id AS blob, md5(text) AS md5 FROM documents WHERE length(text) > 0")
def full_get_reassemble(s, d):
    """Objects read back through their segments, chunk by chunk."""
    c = blob.chunks(X.objects(s, d), "blob", "text", X.CHUNK, checksums=False)
    refs = blob.segments(c, 4).select("blob", F.col("segment").alias("seq"), "first", "last")
    return blob.reassemble(blob.read_segments(refs, c), order=("seq", "entry_id")).select("blob", F.md5("data").alias("md5"))


_OCTETS = f"WITH {X.OBJECTS}, c AS (SELECT blob, length(h) // 2 AS n, unnest(range(0, length(h) // 2, {X.CHUNK})) // {X.CHUNK} AS e FROM obj WHERE length(h) > 0)"


@query(_OCTETS + " SELECT blob, CAST(e AS INTEGER) AS entry_id FROM c WHERE (blob + e) % 7 = 3")
def chunk_verify(s, d):
    """One byte in front of every seventh chunk: those are found by their checksums."""
    c = blob.chunks(X.objects(s, d), "blob", "text", X.CHUNK)
    hit = (F.col("blob") + F.col("entry_id")) % 7 == 3
    return blob.damaged(c.withColumn("data", F.when(hit, F.concat(F.lit(b"?"), F.col("data"))).otherwise(F.col("data")))).select("blob", "entry_id")


@query(
    _OCTETS + ", s AS (SELECT blob, max(e) AS last, max(n) AS n FROM c GROUP BY blob) SELECT d.doc_id AS blob, 1 AS part_number, CASE WHEN s.n IS NULL THEN 'ok' "
    "WHEN d.doc_id % 6 = 1 THEN 'missing' WHEN d.doc_id % 6 = 2 THEN 'length' WHEN d.doc_id % 6 = 3 THEN 'chunk' WHEN d.doc_id % 6 = 4 THEN 'part' ELSE 'ok' END AS status FROM documents d LEFT JOIN s ON s.blob = d.doc_id"
)
def get_verified(s, d):
    """Objects whose last chunk is lost, cut or altered, or whose part has another checksum: none of them reads as whole."""
    o = X.objects(s, d)
    kind = F.col("blob") % 6
    some = F.octet_length("text") > 0
    crc = K.crc32c_fast(F.coalesce("text", F.lit("")).cast("binary"))
    parts = o.select("blob", F.lit(1).alias("part_number"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("len"), F.lit(X.CHUNK).alias("chunk"), F.when(some & (kind == 4), crc + 1).otherwise(crc).alias("crc"))
    c = blob.chunks(o, "blob", "text", X.CHUNK)
    last = c.groupBy("blob").agg(F.max("entry_id").alias("last"))
    c = c.join(last, "blob").where((kind != 1) | (F.col("entry_id") < F.col("last")))
    hit, data = F.col("entry_id") == F.col("last"), F.col("data")
    data = F.when(hit & (kind == 2), F.concat(data, F.lit(b"!"))).when(hit & (kind == 3), F.overlay(data, F.lit(b"\x00"), F.lit(1))).otherwise(data)
    return blob.audit(parts, c.withColumn("data", data).drop("last"))


_WANT = "w AS (SELECT blob, length(h) // 2 AS total, CASE WHEN blob % 4 = 0 THEN -1 ELSE blob % 700 END AS first, CASE blob % 4 WHEN 1 THEN -1 ELSE blob % 900 END AS last FROM obj), r AS (SELECT *, CASE WHEN first < 0 THEN greatest(0, total - last) ELSE first END AS low, CASE WHEN first < 0 OR last < 0 THEN total - 1 ELSE least(last, total - 1) END AS high FROM w), f AS (SELECT blob, total, first, last, CASE WHEN total > 0 AND low < total AND NOT (first < 0 AND last <= 0) THEN low END AS lo, CASE WHEN total > 0 AND low < total AND NOT (first < 0 AND last <= 0) THEN high END AS hi FROM r)"


@query(f"WITH {X.OBJECTS}, {_WANT} SELECT blob, lo AS \"from\", hi AS \"to\" FROM f")
def byte_range_resolve(s, d):
    o = X.objects(s, d).select("blob", F.octet_length("text").cast("bigint").alias("total"))
    first = F.when(F.col("blob") % 4 == 0, -1).otherwise(F.col("blob") % 700).cast("bigint")
    last = F.when(F.col("blob") % 4 == 1, -1).otherwise(F.col("blob") % 900).cast("bigint")
    low, high = blob.resolve_range(first, last, F.col("total"))
    return o.select("blob", low.alias("from"), high.alias("to"))


@query(f"WITH {X.OBJECTS} SELECT blob, md5(substr(h, 201, 1202)) AS hex_md5 FROM obj WHERE length(h) // 2 > 100")
def byte_range_read(s, d):
    o = X.objects(s, d)
    low, high = blob.resolve_range(F.lit(100).cast("bigint"), F.lit(700).cast("bigint"), F.octet_length("text").cast("bigint"))
    want = o.select("blob", low.alias("from"), high.alias("to")).where(F.col("from").isNotNull())
    got = blob.read_range(blob.chunks(o, "blob", "text", X.CHUNK, checksums=False), want, X.CHUNK)
    return got.select("blob", F.md5(F.hex("data")).alias("hex_md5"))


_HEADER = "CASE event_id % 9 WHEN 0 THEN 'bytes=' || a || '-' || b WHEN 1 THEN 'bytes=' || a || '-' WHEN 2 THEN 'bytes=-' || b WHEN 3 THEN 'bytes=' || a || '-' || b || ',5-6' WHEN 4 THEN 'items=1-2' WHEN 5 THEN ' Bytes= ' || a || ' - ' || b WHEN 6 THEN 'bytes=-' WHEN 7 THEN 'bytes=x-' || b ELSE 'bytes=' || a END"


@query(
    f"WITH h AS (SELECT event_id, a, b, {_HEADER} AS header FROM (SELECT event_id, CAST(event_id % 50 AS VARCHAR) AS a, CAST(event_id % 70 AS VARCHAR) AS b FROM events)), "
    "c AS (SELECT *, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, event_id % 9 AS k FROM h), "
    "t AS (SELECT *, CASE WHEN k IN (4, 6, 7, 8) THEN 'full' WHEN k = 3 THEN 'multiple' WHEN k = 2 AND y = 0 THEN 'invalid' WHEN k IN (0, 5) AND y < x THEN 'invalid' ELSE 'range' END AS status FROM c) "
    "SELECT event_id, header, status, CASE WHEN status = 'range' THEN CASE k WHEN 2 THEN -1 ELSE x END END AS first, CASE WHEN status = 'range' THEN CASE k WHEN 1 THEN -1 ELSE y END END AS last FROM t"
)
def range_header_parse(s, d):
    e = X.table(s, d, "events").select("event_id", (F.col("event_id") % 50).cast("string").alias("a"), (F.col("event_id") % 70).cast("string").alias("b"))
    e = e.withColumn("header", F.expr(_HEADER)).withColumn("r", blob.parse_range(F.col("header")))
    return e.select("event_id", "header", "r.status", "r.first", "r.last")


@query(f"WITH {X.PARTS} SELECT upload_id, part_number, seq, len FROM latest")
def multipart_parts_lww(s, d):
    return blob.latest_parts(X.parts(s, d)).select("upload_id", "part_number", "seq", "len")


_LISTED = "listed AS (SELECT upload_id, part_number AS ord, CASE WHEN upload_id % 11 = 0 THEN 8 - part_number WHEN upload_id % 13 = 0 THEN part_number + 1 ELSE part_number END AS part_number, crc + CASE WHEN upload_id % 17 = 0 THEN 1 ELSE 0 END AS crc FROM latest)"


@query(
    f"WITH {X.PARTS}, {_LISTED}, j AS (SELECT x.*, r.len AS len, r.crc AS rcrc, lag(x.part_number) OVER w AS prev, lead(x.ord) OVER w IS NULL AS final FROM listed x LEFT JOIN latest r ON r.upload_id = x.upload_id AND r.part_number = x.part_number WINDOW w AS (PARTITION BY x.upload_id ORDER BY x.ord)), "
    "g AS (SELECT upload_id, count(*) AS n_parts, CAST(sum(len) AS BIGINT) AS total, CASE WHEN coalesce(bool_or(prev >= part_number), false) THEN 'order' WHEN bool_or(len IS NULL) THEN 'unknown part' WHEN coalesce(bool_or(crc <> rcrc), false) THEN 'checksum' WHEN coalesce(bool_or(NOT final AND len < 5), false) THEN 'too small' ELSE 'ok' END AS status FROM j GROUP BY upload_id) "
    "SELECT upload_id, status, n_parts, CASE WHEN status = 'ok' THEN total END AS length FROM g"
)
def multipart_complete(s, d):
    latest = blob.latest_parts(X.parts(s, d))
    number = F.when(F.col("upload_id") % 11 == 0, 8 - F.col("part_number")).when(F.col("upload_id") % 13 == 0, F.col("part_number") + 1).otherwise(F.col("part_number"))
    listed = latest.select("upload_id", F.col("part_number").alias("ord"), number.alias("part_number"), (F.col("crc") + F.when(F.col("upload_id") % 17 == 0, 1).otherwise(0)).alias("crc"))
    return blob.complete(listed, latest, 5)


@query(f"WITH {X.PARTS} SELECT upload_id, CAST(sum(len) AS BIGINT) AS length, arg_min(crc, part_number) AS crc, CAST(sum((len + 9) // 10) AS BIGINT) AS entries FROM latest GROUP BY 1")
def head_objects(s, d):
    latest = blob.latest_parts(X.parts(s, d)).withColumn("chunk", F.lit(10))
    whole = blob.assemble(latest.select("upload_id", F.col("part_number").alias("ord"), "part_number"), latest)
    return blob.head(whole).select("upload_id", "length", "crc", "entries")


@query(f"WITH {X.PARTS} SELECT upload_id, part_number, len, CAST(coalesce(sum(len) OVER (PARTITION BY upload_id ORDER BY part_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM latest")
def part_prefix_sums(s, d):
    return blob.part_offsets(blob.latest_parts(X.parts(s, d))).select("upload_id", "part_number", "len", "at")


@query(f"WITH {X.PARTS}, o AS (SELECT upload_id, part_number, len, CAST(coalesce(sum(len) OVER (PARTITION BY upload_id ORDER BY part_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM latest) SELECT upload_id, part_number, greatest(20, pos) - pos AS skip, least(90, pos + len - 1) - greatest(20, pos) + 1 AS take FROM o WHERE greatest(20, pos) <= least(90, pos + len - 1)")
def part_range_slices(s, d):
    return blob.part_slices(blob.latest_parts(X.parts(s, d)), F.lit(20).cast("bigint"), F.lit(90).cast("bigint"))


# ---- writes


@query(X.KEYSPACE + ", t AS (SELECT CASE WHEN user_id % 5 > 0 THEN user_id || event_type END AS token, event_id AS seq, value FROM ev) SELECT token, min(seq) AS seq, arg_min(value, seq) AS value FROM t WHERE token IS NOT NULL GROUP BY token UNION ALL SELECT token, seq, value FROM t WHERE token IS NULL")
def token_dedup(s, d):
    e = X.events(s, d)
    token = F.when(F.col("user_id") % 5 > 0, F.concat(F.col("user_id").cast("string"), "event_type"))
    return mutations.first_of_token(e.select(token.alias("token"), F.col("event_id").alias("seq"), "value"))


_COPY = "(SELECT key, 'c/' || substr(key, 3) AS dst, len FROM live )"


@query(X.KEYSPACE + f"SELECT key, len FROM live UNION ALL SELECT dst, len FROM {_COPY}")
def copy_result(s, d):
    view = live(s, d)
    pairs = view.select(F.col("key").alias("src"), F.concat(F.lit("c/"), F.substring("key", 3, 100)).alias("dst"))
    new = mutations.copy(view, pairs, F.lit(2**60).cast("bigint"), F.lit(0), F.lit(0), F.lit(0))
    return resolve.live(X.facts(s, d).unionByName(new), X.ranges(s, d)).select("key", "len")


@query(X.KEYSPACE + f"SELECT dst AS key, len FROM {_COPY}")
def rename_result(s, d):
    view = live(s, d)
    pairs = view.select(F.col("key").alias("src"), F.concat(F.lit("c/"), F.substring("key", 3, 100)).alias("dst"))
    new = mutations.copy(view, pairs, F.lit(2**60).cast("bigint"), F.lit(0), F.lit(0), F.lit(0), rename=True)
    return resolve.live(X.facts(s, d).unionByName(new), X.ranges(s, d)).select("key", "len")


@query(X.KEYSPACE + "SELECT key, len FROM live WHERE NOT (key >= 'u/00020' AND key < 'u/00060/5') AND NOT starts_with(key, 'u/0007')")
def delete_range_effect(s, d):
    r = X.ranges(s, d).unionByName(mutations.delete_range("u/00020", "u/00060/5", s, 2**60, 0, 0)).unionByName(mutations.delete_prefix("u/0007", s, 2**60, 1, 0))
    return resolve.live(X.facts(s, d), r).select("key", "len")


@query(X.KEYSPACE + "SELECT key, len FROM live WHERE event_id % 3 <> 0")
def conditional_delete(s, d):
    view = live(s, d)
    want = view.select("key", F.when(F.col("event_id") % 3 == 0, F.col("p")).otherwise(F.col("p") - 1).alias("ep"), F.col("l").alias("el"), F.col("n").alias("en"))
    log = X.facts(s, d)
    gone = mutations.conditional_delete(view, want, F.lit(2**60).cast("bigint"), F.lit(0), F.lit(0), log.columns)
    return resolve.live(log.unionByName(gone), X.ranges(s, d)).select("key", "len")


@query("SELECT event_id, CASE WHEN k = '' OR length(k) > 1024 THEN 'error' ELSE 'deleted' END AS status FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('k', CAST(1000 + event_id % 50 AS INTEGER)) ELSE 'a/' || event_id END AS k FROM events)")
def batch_delete(s, d):
    e = X.table(s, d, "events")
    key = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.repeat(F.lit("k"), (F.col("event_id") % 50 + 1000).cast("int"))).otherwise(F.concat(F.lit("a/"), F.col("event_id").cast("string")))
    return mutations.batch_delete(e.select("event_id", key.alias("key"))).drop("key")


# ---- compaction, garbage


@query(
    X.KEYSPACE + ", b AS (SELECT max(p) // 1000 - CAST(86400000 AS BIGINT) * 10 AS cut FROM mut), k AS (SELECT x.* FROM win x, b WHERE NOT (type = 2 AND p // 1000 <= b.cut)), o AS (SELECT rt.* FROM rt, b WHERE rt.p <= b.cut * 1000) "
    "SELECT key, p, type FROM k x WHERE NOT EXISTS (SELECT 1 FROM o rt WHERE rt.s <= x.key AND x.key < rt.e AND " + X.NEWER + ")"
)
def compaction_bottommost(s, d):
    f = X.facts(s, d).withColumn("created_at", F.floor(F.col("p") / 1000))
    grace = 86_400_000 * 10
    now = f.agg(F.max("p")).first()[0] // 1000
    return compaction.compact(f, X.ranges(s, d), True, now, grace, micros=True)[0].select("key", "p", "type")


@query(X.KEYSPACE + "SELECT key, p, type FROM win")
def compaction_carry(s, d):
    return compaction.compact(X.facts(s, d), X.ranges(s, d), False, X.NOW, 0)[0].select("key", "p", "type")


@query(f"WITH {X.TABLES} SELECT * FROM tabs")
def table_statistics(s, d):
    return X.tables(s, d)


@query(f"WITH {X.TABLES} SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM tabs GROUP BY level")
def level_stats(s, d):
    return compaction.level_statistics(X.tables(s, d))


@query(f"WITH {X.TABLES}, sc AS (SELECT level, sum(bytes) / (1000000.0 * pow(4, level - 1)) AS score FROM tabs WHERE level >= 1 GROUP BY level) SELECT CAST(CASE WHEN (SELECT count(*) FROM tabs WHERE level = 0) >= 1000 THEN 0 ELSE (SELECT level FROM sc WHERE score > 1 ORDER BY score DESC, level LIMIT 1) END AS INTEGER) AS level")
def pick_level(s, d):
    return compaction.pick_level(X.tables(s, d), trigger=1000, base=1_000_000, growth=4)


@query(f"WITH {X.TABLES} SELECT ledger, level FROM tabs WHERE min_key <= '00004200' AND max_key >= '00001700'")
def table_overlap(s, d):
    return compaction.overlapping(X.tables(s, d), "00001700", "00004200").select("ledger", "level")


@query(f"WITH {X.REFS} SELECT DISTINCT blob FROM refs WHERE blob NOT IN (SELECT blob FROM refs WHERE ledger % 2 = 0) AND blob NOT IN (SELECT blob FROM refs WHERE ledger % 5 = 1)")
def orphan_blobs(s, d):
    r = X.references(s, d)
    return compaction.orphans(r, r.where("ledger % 2 = 0"), r.where("ledger % 5 = 1"))


@query(f"WITH {X.REFS}, o AS (SELECT DISTINCT blob FROM refs WHERE ledger % 2 = 1 AND blob NOT IN (SELECT blob FROM refs WHERE ledger % 4 = 0)) SELECT blob FROM o WHERE blob NOT IN (SELECT blob FROM refs WHERE ledger % 4 = 2)")
def reclaimable_blobs(s, d):
    r = X.references(s, d)
    own = compaction.orphans(r.where("ledger % 2 = 1"), r.where("ledger % 4 = 0"))
    return compaction.reclaimable(own, r.where("ledger % 4 = 2"))


@query("WITH e AS (SELECT event_id AS seq, CASE WHEN value > 5 OR event_id % 2 = 0 THEN 'add' ELSE 'remove' END AS op, user_id AS ledger FROM events) SELECT ledger FROM e GROUP BY ledger HAVING arg_max(op, seq) = 'add'")
def manifest_replay(s, d):
    e = X.table(s, d, "events").select(F.col("event_id").alias("seq"), F.when((F.col("value") > 5) | (F.col("event_id") % 2 == 0), "add").otherwise("remove").alias("op"), F.col("user_id").alias("ledger"))
    return compaction.replay(e).select("ledger")


@query(f"WITH {_UPLOADS} SELECT upload_id FROM up WHERE created_at <= (SELECT max(created_at) FROM up) - CAST(86400000 AS BIGINT) * 365")
def ttl_sweep(s, d):
    u = X.uploads(s, d)
    return compaction.expired_uploads(u, u.agg(F.max("created_at")).first()[0], 86_400_000 * 365).select("upload_id")


@query(f"WITH {_UPLOADS} SELECT upload_id, key FROM up WHERE upload_id % 4 <> 0")
def abort_uploads(s, d):
    u = X.uploads(s, d)
    gone = u.where("upload_id % 4 = 0")
    return compaction.abort(u, gone.union(gone)).select("upload_id", "key")


@query("WITH i AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS token, 1000 * turn AS created_at, (conv_id + turn) % 3 = 0 AS there FROM conversations) SELECT token, CASE WHEN there THEN 'finish' WHEN created_at <= 3000 THEN 'drop' ELSE 'wait' END AS action FROM i")
def rename_intent_sweep(s, d):
    c = X.table(s, d, "conversations")
    i = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("token"), (F.col("turn") * 1000).alias("created_at"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("there"))
    return compaction.sweep_intents(i.drop("there"), i.where("there"), 63_000)


# ---- cluster


@query(f"WITH {X.LEASES}, m AS (SELECT unnest([0, 1, 2, 3]) AS node) SELECT CAST(m.node AS INTEGER) AS node, count(le.bucket) AS owned FROM m LEFT JOIN le ON le.node = m.node GROUP BY m.node")
def node_ownership(s, d):
    return cluster.ownership(X.members(s), X.leases(s, d)).select("node", "owned")


@query(f"WITH {X.BUCKETS}, {X.LEASES}, p AS (SELECT bucket, unnest(range(0, 8)) AS part FROM bk) SELECT p.bucket AS bucket, count(*) AS free FROM p LEFT JOIN le ON le.bucket = p.bucket AND le.part = p.part WHERE le.node IS NULL GROUP BY 1")
def ownerless_boxes(s, d):
    return cluster.ownerless(X.buckets(s, d), X.leases(s, d))


@query(f"WITH {X.BUCKETS}, {X.LEASES} SELECT bk.bucket AS bucket, coalesce(string_agg(DISTINCT CAST(le.node AS VARCHAR), ',' ORDER BY CAST(le.node AS VARCHAR)), '') AS owners FROM bk LEFT JOIN le ON le.bucket = bk.bucket GROUP BY 1")
def partition_owners(s, d):
    return cluster.owners(X.buckets(s, d), X.leases(s, d))


_STICKY = f"WITH {X.BUCKETS}, {X.LEASES}, p AS (SELECT bucket, CAST(unnest(range(0, 8)) AS INTEGER) AS part FROM bk), h AS (SELECT p.bucket AS bucket, p.part AS part, CASE WHEN le.node < 4 THEN le.node END AS node FROM p LEFT JOIN le ON le.bucket = p.bucket AND le.part = p.part), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY bucket, part) AS rn FROM h)"


@query(_STICKY + " SELECT bucket, part, node, CASE WHEN node IS NULL THEN 'unowned' WHEN rn <= ceil((SELECT count(*) FROM p) / 4.0) THEN 'keep' ELSE 'overflow' END AS state FROM r")
def balance_sticky(s, d):
    return cluster.sticky(cluster.partitions(X.buckets(s, d)), X.members(s), X.leases(s, d))


@query(f"WITH {X.LEASES}, l AS (SELECT node, count(*) AS load FROM le GROUP BY node) SELECT node FROM l ORDER BY load, node LIMIT 1")
def least_loaded(s, d):
    return cluster.least_loaded(X.leases(s, d).groupBy("node").agg(F.count("*").alias("load")))


@query("SELECT user_id % 8 AS part, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1")
def engine_counters(s, d):
    e = X.table(s, d, "events").withColumn("part", F.col("user_id") % 8)
    return cluster.counters(e, F.col("event_type"), "part", ["click", "error", "signup"])


@query(f"WITH {X.TABLES} SELECT CAST(sum(CASE WHEN level = 1 THEN 0 ELSE entries END) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM tabs")
def storage_totals(s, d):
    t = X.tables(s, d).withColumn("entries", F.when(F.col("level") != 1, F.col("entries")))
    return cluster.storage_totals(t, ["entries", "bytes"])


@query(f"WITH {X.BUCKETS} SELECT bucket FROM bk WHERE contains(bucket, '1')")
def bucket_name_filter(s, d):
    return cluster.name_filter(X.buckets(s, d), "bucket", "1").select("bucket")


# ---- access


_WHO = "(VALUES ('User:BUILDING'), ('User:anonymous'), ('User:nobody'), ('Service:x'))"


@query(f"WITH {X.RULES} SELECT id, who, (who = 'Service:x' OR CASE WHEN owner IS NULL THEN who <> 'User:anonymous' ELSE owner = who OR coalesce(reader = 'AllUsers' OR (reader = 'AuthenticatedUsers' AND who <> 'User:anonymous') OR reader = who, false) END) AS may FROM ru, {_WHO} w(who)")
def acl_permits(s, d):
    who = s.createDataFrame([("User:BUILDING",), ("User:anonymous",), ("User:nobody",), ("Service:x",)], "who string")
    both = X.rules(s, d).crossJoin(F.broadcast(who))  # four principals against all rules
    return both.select("id", "who", access.authorized(F.col("owner"), F.col("grants"), F.col("who"), F.lit("READ"), ["Service:*"]).alias("may"))


@query(f"WITH {X.RULES} SELECT id FROM ru WHERE owner IS NULL OR owner = 'User:BUILDING' OR reader IN ('AllUsers', 'AuthenticatedUsers', 'User:BUILDING')")
def acl_visible(s, d):
    return access.visible_buckets(X.rules(s, d).withColumnRenamed("id", "bucket"), "User:BUILDING").select(F.col("bucket").alias("id"))


@query(f"WITH {X.BUCKETS} SELECT bucket FROM bk WHERE owner = 'User:r1'")
def list_boxes_owned(s, d):
    return access.owned_buckets(X.buckets(s, d), "User:r1").select("bucket")


@query(f"WITH {X.RULES} SELECT id, CASE WHEN reader = 'AllUsers' THEN '' WHEN reader IS NULL THEN '' ELSE reader || ':READ;' END || 'User:new:READ+WRITE' AS grants FROM ru")
def acl_edit(s, d):
    """AllUsers revoked, one grantee added, written as text."""
    g = mutations.revoke(F.col("grants"), F.lit("AllUsers"))
    g = mutations.grant(g, F.lit("User:new"), F.array(F.lit("WRITE"), F.lit("READ")))
    return X.rules(s, d).select("id", F.array_join(F.transform(g, K.format_grant), ";").alias("grants"))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'AllUsers:READ' WHEN 2 THEN 'AllUsers:READ+WRITE' WHEN 3 THEN 'AuthenticatedUsers:READ' WHEN 4 THEN '' END AS grants FROM customer")
def canned_acl(s, d):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "private").when(k == 1, "Public-Read ").when(k == 2, "public-read-write").when(k == 3, "authenticated-read").when(k == 4, "bucket-owner-read").otherwise("odd")
    return X.table(s, d, "customer").select(F.col("c_custkey").alias("id"), K.canned_grants(name).alias("grants"))


@query("SELECT c_custkey AS id, 'a:b' AS grantee, 'READ+WRITE' AS ops, CASE WHEN c_custkey % 2 = 0 THEN 'User:' || c_name ELSE 'Service:' || c_name END AS principal FROM customer")
def grant_text(s, d):
    c = X.table(s, d, "customer")
    g = K.parse_grant(F.lit(" a:b :write + READ+READ"))
    p = K.principal(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Service:"), "c_name")))
    return c.select(F.col("c_custkey").alias("id"), g["grantee"].alias("grantee"), F.array_join(g["ops"], "+").alias("ops"), p.alias("principal"))


# ---- text functions


@query("SELECT doc_id, replace(source, 's', 'S') || ' +/A%zz%4%' AS decoded, 'b' AS bucket, 'k/' || doc_id AS key FROM documents")
def path_decode(s, d):
    t = X.table(s, d, "documents")
    path = F.concat(F.lit("/b/k/"), F.col("doc_id").cast("string"))
    return t.select("doc_id", K.percent_decode(F.concat(F.replace("source", F.lit("s"), F.lit("%53")), F.lit("%20+%2F%41%zz%4%"))).alias("decoded"), K.path_bucket(path).alias("bucket"), K.path_key(path).alias("key"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b / 1024.0 >= 100 THEN printf('%.0f KiB', round(b / 1024.0, 0)) WHEN b / 1024.0 >= 10 THEN printf('%.1f KiB', round(b / 1024.0, 1)) ELSE printf('%.2f KiB', round(b / 1024.0, 2)) END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)")
def human_sizes(s, d):
    return X.table(s, d, "documents").select("doc_id", K.human_bytes(F.octet_length("text")).alias("size"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS http, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events")
def date_formats(s, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return X.table(s, d, "events").select("event_id", K.http_date(ms).alias("http"), K.iso_date(ms).alias("iso"))


# ---- metrics


@query("SELECT name, t, id, v, row_number() OVER (PARTITION BY name ORDER BY t, id) AS place FROM (SELECT event_type AS name, epoch_us(ts) AS t, event_id AS id, value AS v FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 60)")
def metrics_last_n(s, d):
    return metrics.last_n(X.samples(s, d), ["name"], ["t", "id"])


@query("SELECT event_type AS name, epoch_us(ts) AS t, value AS v FROM events ORDER BY 1, 2")
def metrics_merge_by_name(s, d):
    return metrics.merged(X.samples(s, d))


@query("SELECT name, count(id) AS n FROM (SELECT unnest(['click', 'error', 'absent']) AS name) LEFT JOIN (SELECT event_type, event_id AS id FROM events) ON name = event_type GROUP BY name")
def metrics_series_for(s, d):
    return metrics.series_for(X.samples(s, d), ["click", "error", "absent"]).groupBy("name").agg(F.count("id").alias("n"))


@query("SELECT event_id AS t, event_type AS name, 'a\"b' AS quoted, CAST(user_id AS VARCHAR) AS box, CAST(event_id % 1000 AS DOUBLE) / 8 AS v FROM events WHERE event_id % 4 < 2")
def prometheus_parse(s, d):
    e = X.table(s, d, "events")
    value = (F.col("event_id") % 1000 / 8).cast("string")
    line = F.concat("event_type", F.lit('{quoted="a\\"b",box="'), F.col("user_id").cast("string"), F.lit('"} '), value, F.lit(" 1700000000"))
    body = F.when(F.col("event_id") % 4 < 2, F.concat(F.lit("# HELP x\n\n"), line, F.lit("\nbroken{a=\"b\" 1\nnan_metric NaN\ninf_metric +Inf\nlonely\n"))).otherwise(F.concat("event_type", F.lit(" -Inf")))
    got = metrics.samples(e.select(F.col("event_id").alias("t"), F.lit("n1").alias("target"), body.alias("body")))
    return got.select("t", "name", F.col("labels")["quoted"].alias("quoted"), F.col("labels")["box"].alias("box"), "v")


@query("SELECT event_type || '{node=\"' || CAST(user_id AS VARCHAR) || '\",box=\"a\\\"b\\\\c\\n\"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type, user_id")
def prometheus_exposition(s, d):
    e = X.table(s, d, "events").groupBy("event_type", F.col("user_id").alias("node")).agg(F.count("*").alias("n")).withColumn("box", F.lit('a"b\\c\n'))
    return metrics.exposition(e, F.col("event_type"), ["node", "box"], F.col("n"))
