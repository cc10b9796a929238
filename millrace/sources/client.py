"""Objects of a bucket by key: the calls of an object store, each a plan over the bucket's snapshot.

Bulk forms take and give DataFrames; forms for one key give Python values. A missing key is None, or KeyError where the
call needs it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import crc32c_fast, encode_token, etag
from ..operators import blob, listing, mutations
from ..operators import scan as S
from ..operators.clock import stamp
from .store import Bucket, Busy

PUT = 1


class Objects:
    def __init__(self, bucket: Bucket, chunk: int = blob.CHUNK, min_part: int = blob.MIN_PART, most_uploads: int = 1000):
        self.bucket, self.spark, self.chunk, self.min_part, self.most_uploads = bucket, bucket.spark, chunk, min_part, most_uploads

    # ---- writes

    def put_all(self, rows: DataFrame, owner: str | None = None) -> int:
        """rows (key, data binary, optionally content_type, user_meta, and token with seq): one commit for all. Of rows of
        one token the first by seq counts."""
        if "token" in rows.columns:
            rows = mutations.first_of_token(rows).drop("token", "seq")
        run = uuid.uuid4().hex
        now = self.bucket.clock.wall()
        rows = stamp(rows.withColumn("blob", F.xxhash64("key", F.lit(run))), self.bucket.clock).cache()
        n = F.octet_length("data").cast("bigint")
        segs = F.when(n > 0, F.array(F.struct("blob", F.lit(0).cast("bigint").alias("first"), F.floor((n - 1) / self.chunk).alias("last")))).otherwise(F.array().cast("array<struct<blob:bigint,first:bigint,last:bigint>>"))
        part = F.struct(n.alias("len"), F.lit(self.chunk).alias("chunk"), crc32c_fast(F.col("data")).alias("crc"), segs.alias("segs"))
        facts = rows.withColumns({"type": F.lit(PUT), "created_at": F.lit(now).cast("bigint"), "parts": F.array(part), "owner": F.lit(owner)})
        version = self.bucket.commit(facts.drop("data", "blob"), chunks=blob.chunks(rows, "blob", "data", self.chunk))
        rows.unpersist()
        return version

    def put(self, key: str, data: bytes, content_type: str | None = None) -> int:
        return self.put_all(self.spark.createDataFrame([(key, bytearray(data), content_type)], "key string, data binary, content_type string"))

    def _tick(self, count: int = 1):
        p, l, n = self.bucket.clock.tick(count)
        return F.lit(p).cast("bigint"), F.lit(l), F.lit(n)

    def delete(self, *keys: str) -> int:
        gone = mutations.delete(self.spark.createDataFrame([(k,) for k in keys], "key string"), *self._tick(), ["key", "p", "l", "n", "type"])
        return self.bucket.commit(gone)

    def delete_range(self, start: str | None, end: str | None) -> int:
        return self.bucket.commit(ranges=mutations.delete_range(start, end, self.spark, *self.bucket.clock.tick()))

    def delete_prefix(self, prefix: str) -> int:
        return self.bucket.commit(ranges=mutations.delete_prefix(prefix, self.spark, *self.bucket.clock.tick()))

    def _copy(self, src: str, dst: str, rename: bool) -> int:
        if src == dst:
            raise ValueError("source and target are the same key")
        pair = self.spark.createDataFrame([(src, dst)], "src string, dst string")
        new = mutations.copy(self.bucket.get(src), pair, *self._tick(2), F.lit(self.bucket.clock.wall()).cast("bigint"), rename)
        if new.isEmpty():
            raise KeyError(src)
        return self.bucket.commit(new)

    def copy(self, src: str, dst: str) -> int:
        return self._copy(src, dst, False)

    def rename(self, src: str, dst: str) -> int:
        return self._copy(src, dst, True)

    def set_grants(self, key: str, grants: list[tuple[str, list[str]]]) -> int:
        change = self.spark.createDataFrame([(key, grants)], "key string, new_grants array<struct<grantee:string,ops:array<string>>>")
        return self.bucket.commit(mutations.set_grants(self.bucket.get(key), change, *self._tick()))

    # ---- reads

    def get_all(self, keys: DataFrame | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
        """key, data of live objects (of the keys given), whole or the inclusive range; ranges that an object cannot
        satisfy give no row. A chunk that is missing, of a wrong length or damaged is an error, and so is a whole part
        whose checksum is not that of its bytes, or an object of a wrong length: bytes are right or not given."""
        view = self.bucket.live()
        if keys is not None:
            view = view.join(keys.select("key").distinct(), "key", "left_semi")
        total = blob.object_length(F.col("parts"))
        low, high = F.lit(0).cast("bigint"), total - 1
        if first is not None:
            low, high = blob.resolve_range(F.lit(first).cast("bigint"), F.lit(-1 if last is None else last).cast("bigint"), total)
            view = view.where(low.isNotNull())
        each = view.select("key", low.alias("low"), high.alias("high"), F.posexplode("parts").alias("at", "part"))
        before = each.withColumn("upload_id", F.col("key")).select("key", "upload_id", "low", "high", F.col("at").alias("part_number"), F.col("part.len").alias("len"), "part")
        slices = blob.part_offsets(before).where((F.col("at") <= F.col("high")) & (F.col("at") + F.col("len") > F.col("low")))
        seg = slices.select("key", "part_number", (F.col("low") - F.col("at")).alias("from"), (F.col("high") - F.col("at")).alias("to"), F.col("part.chunk").alias("chunk"), F.col("part.len").alias("len"), F.col("part.crc").alias("part_crc"), F.explode("part.segs").alias("s"))
        want = seg.select("key", "part_number", "from", "to", "chunk", "len", "part_crc", F.col("s.blob").alias("blob"), F.explode(F.sequence("s.first", "s.last")).alias("entry_id"))
        base = F.col("entry_id") * F.col("chunk")
        want = want.where((base <= F.col("to")) & (base + F.col("chunk") > F.col("from")))
        got = want.join(self.bucket.rows("chunks"), ["blob", "entry_id"], "left")
        skip = F.greatest(F.lit(0).cast("bigint"), F.col("from") - base)
        take = F.least(F.col("chunk") - 1, F.col("to") - base) - skip + 1
        fine = blob.sound(F.col("data"), F.col("crc"), F.least(F.col("chunk").cast("bigint"), F.col("len") - base))
        trimmed = got.withColumn("data", F.substring(fine, (skip + 1).cast("int"), take.cast("int")))
        if first is None:  # parts are whole here
            part = blob.reassemble(trimmed.withColumn("crc", F.col("part_crc")), ("key", "part_number", "crc"))
            trimmed = part.withColumn("data", F.when(crc32c_fast(F.col("data")) != F.col("crc"), F.raise_error(F.lit("damaged part"))).otherwise(F.col("data"))).withColumn("entry_id", F.lit(0))
        whole = blob.reassemble(trimmed, "key", ("part_number", "entry_id"))
        out = view.select("key", (high - low + 1).alias("_n")).join(whole, "key", "left").withColumn("data", F.coalesce("data", F.lit(b"")))
        right = F.when(F.octet_length("data") != F.col("_n"), F.raise_error(F.lit("object of a wrong length"))).otherwise(F.col("data"))
        return out.select("key", right.alias("data"))

    def get(self, key: str, first: int | None = None, last: int | None = None) -> bytes | None:
        """The bytes; with first (and last) an inclusive range, negative first for the last so many bytes (in last)."""
        row = self.get_all(self.spark.createDataFrame([(key,)], "key string"), first, last).first()
        return None if row is None else bytes(row.data)

    def head(self, key: str):
        row = blob.head(self.bucket.get(key)).select("key", "length", "content_type", "user_meta", "crc", etag(F.col("crc")).alias("etag"), "p", "l", "n", "created_at").first()
        return row

    def list(self, query: S.ScanQuery = S.ScanQuery(), delimiter: str = "") -> dict:
        """A page: keys (key, length, created_at), prefixes, next token."""
        view = self.bucket.live().select("key", blob.object_length(F.col("parts")).alias("length"), "created_at")
        got = S.page(view, query)
        rows, prefixes = [], []
        for r in got.rows:
            at = r.key.find(delimiter, len(query.prefix)) if delimiter else -1
            if at < 0:
                rows.append(r)
            elif r.key[: at + len(delimiter)] not in prefixes:
                prefixes.append(r.key[: at + len(delimiter)])
        return {"keys": rows, "prefixes": prefixes, "next": encode_token(got.next) if got.next is not None else None}

    def roll_up(self, prefix: str = "", delimiter: str = "/") -> DataFrame:
        """All entries under a prefix, not a page of them."""
        return listing.roll_up(self.bucket.live(), prefix, delimiter)

    # ---- multipart

    def create_upload(self, key: str, content_type: str | None = None, user_meta: dict[str, str] | None = None) -> str:
        if self.bucket.open_uploads().limit(self.most_uploads).count() >= self.most_uploads:
            raise Busy(f"{self.most_uploads} uploads are in flight")
        upload = uuid.uuid4().hex
        self._upload(upload, key, content_type, json.dumps(user_meta) if user_meta else None, True)
        return upload

    def _upload(self, upload: str, key: str, content_type: str | None, user_meta: str | None, is_open: bool, **more: DataFrame) -> int:
        p, l, _ = self.bucket.clock.tick()
        row = (upload, key, content_type, user_meta, self.bucket.clock.wall(), is_open, p * 1_000_000 + l)
        facts = more.pop("facts", None)
        return self.bucket.commit(facts, uploads=self.spark.createDataFrame([row], "upload_id string, key string, content_type string, user_meta string, created_at long, open boolean, seq long"), **more)

    def _open(self, upload: str):
        row = self.bucket.open_uploads().where(F.col("upload_id") == upload).first()
        if row is None:
            raise KeyError(upload)
        return row

    def upload_part(self, upload: str, number: int, data: bytes) -> int:
        """Writes a part, replacing an earlier one of its number; gives its checksum."""
        return self._part(upload, number, self.spark.createDataFrame([(bytearray(data),)], "data binary"))

    def _part(self, upload: str, number: int, data: DataFrame) -> int:
        """data: one row."""
        self._open(upload)
        if not 1 <= number <= blob.MAX_PARTS:
            raise ValueError("part number")
        p, l, _ = self.bucket.clock.tick()
        df = data.select(F.lit(upload).alias("upload_id"), F.lit(number).alias("part_number"), F.lit(p * 1_000_000 + l).cast("bigint").alias("seq"), "data")
        df = df.withColumns({"blob": F.xxhash64("upload_id", "part_number", "seq"), "len": F.octet_length("data").cast("bigint"), "chunk": F.lit(self.chunk), "crc": crc32c_fast(F.col("data"))}).cache()
        self.bucket.commit(parts=df.drop("data"), chunks=blob.chunks(df, "blob", "data", self.chunk))
        crc = df.select("crc").first().crc
        df.unpersist()
        return crc

    def upload_part_copy(self, upload: str, number: int, src: str, first: int | None = None, last: int | None = None) -> int:
        """The bytes go from chunks to chunks on the executors."""
        data = self.get_all(self.spark.createDataFrame([(src,)], "key string"), first, last).select("data").cache()
        try:
            if data.select(F.lit(1)).isEmpty():
                raise KeyError(src)
            return self._part(upload, number, data)
        finally:
            data.unpersist()

    def complete_upload(self, upload: str, listed: list[tuple[int, int]]) -> int:
        """listed: (part number, checksum) in ascending order; parts left out are dropped."""
        up = self._open(upload)
        parts = blob.latest_parts(self.bucket.rows("parts").where(F.col("upload_id") == upload))
        want = self.spark.createDataFrame([(upload, i, n, c) for i, (n, c) in enumerate(listed)], "upload_id string, ord int, part_number int, crc long")
        got = blob.complete(want, parts, self.min_part).first()
        if got is None or got.status != "ok":
            raise ValueError("no parts" if got is None else got.status)
        segs = F.when(F.col("len") > 0, F.array(F.struct("blob", F.lit(0).cast("bigint").alias("first"), F.floor((F.col("len") - 1) / F.col("chunk")).alias("last")))).otherwise(F.array().cast("array<struct<blob:bigint,first:bigint,last:bigint>>"))
        whole = blob.assemble(want, parts.withColumn("segs", segs)).select(F.lit(up.key).alias("key"), F.transform("parts", lambda x: F.struct(x["len"].alias("len"), x["chunk"].alias("chunk"), x["crc"].alias("crc"), x["segs"].alias("segs"))).alias("parts"))
        p, l, n = self._tick()
        fact = whole.withColumns({"p": p, "l": l, "n": n, "type": F.lit(PUT), "content_type": F.lit(up.content_type), "user_meta": F.from_json(F.lit(up.user_meta), "map<string,string>"), "created_at": F.lit(self.bucket.clock.wall()).cast("bigint")})
        return self._upload(upload, up.key, up.content_type, up.user_meta, False, facts=fact)

    def abort_upload(self, upload: str) -> None:
        """Closes an upload; one that is not open is fine."""
        row = self.bucket.open_uploads().where(F.col("upload_id") == upload).first()
        if row is not None:
            self._upload(upload, row.key, row.content_type, row.user_meta, False)

    def uploads(self, prefix: str = "", **markers) -> DataFrame:
        return listing.uploads(self.bucket.open_uploads(), prefix, **markers)

    def parts(self, upload: str, marker: int = 0, limit: int = 1000) -> DataFrame:
        return listing.parts(blob.latest_parts(self.bucket.rows("parts")), upload, marker, limit)
