"""Scalar functions over keys, checksums, tokens and grants, as Columns; the few that plan a query run on the driver."""

from __future__ import annotations

import base64

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
OPERATIONS = ["READ", "WRITE", "READ_ACP", "WRITE_ACP", "ADMIN"]
ALL_USERS, AUTHENTICATED_USERS, ANONYMOUS = "AllUsers", "AuthenticatedUsers", "User:anonymous"
MAX_KEY_BYTES, MAX_METADATA_BYTES = 1024, 8192


def prefix_successor(prefix: bytes) -> bytes | None:
    """Least byte string above all that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def crc32c_table() -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ POLYNOMIAL * (k & 1)
        out.append(k)
    return out


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary or string column, 0 .. 2**32 - 1, in the JVM: a fold over the bytes. For long payloads prefer
    crc32c_fast."""
    table = F.array(*[F.lit(x).cast("bigint") for x in crc32c_table()])
    octets = F.hex(data.cast("binary"))
    byte = lambda i: F.conv(F.substring(octets, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    step = lambda s, i: F.shiftrightunsigned(s, 8).bitwiseXOR(F.element_at(table, (s.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)) + 1).cast("int")))
    places = F.when(F.length(octets) > 0, F.sequence(F.lit(0), (F.length(octets) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(data.isNotNull(), F.aggregate(places, F.lit(0xFFFFFFFF).cast("bigint"), step).bitwiseXOR(F.lit(0xFFFFFFFF)))


def crc32c_fast(data: Column) -> Column:
    """The same for long payloads: a Pandas UDF that steps through all values of a batch at once."""
    import numpy as np
    import pandas as pd

    table = np.array(crc32c_table(), np.uint32)

    def of(values):
        some = [(i, v) for i, v in enumerate(values) if v is not None]
        some.sort(key=lambda x: -len(x[1]))
        size = np.array([len(v) for _, v in some], np.int64)
        flat = np.frombuffer(b"".join(bytes(v) for _, v in some), np.uint8)
        at = np.cumsum(size) - size
        crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
        for k in range(int(size[0]) if len(some) else 0):
            n = int(np.searchsorted(-size, -k, "left"))
            crc[:n] = crc[:n] >> 8 ^ table[(crc[:n] ^ flat[at[:n] + k]) & 255]
        out: list[int | None] = [None] * len(values)
        for (i, _), c in zip(some, (crc ^ np.uint32(0xFFFFFFFF)).tolist()):
            out[i] = c
        return pd.Series(out, dtype="Int64")

    of.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "bigint")(data.cast("binary"))


def partition_of(key: Column, partitions: int) -> Column:
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    return (crc32c(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")


def partition_of_key(key: str, partitions: int) -> int:
    """The same for one key, so that a point lookup can name its partition directory."""
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    crc, table = 0xFFFFFFFF, crc32c_table()
    for b in key.encode():
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return ((crc ^ 0xFFFFFFFF) & 0x7FFFFFFF) % partitions


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def valid_key(key: Column) -> Column:
    return F.coalesce((F.octet_length(key) > 0) & (F.octet_length(key) <= MAX_KEY_BYTES), F.lit(False))


def valid_bucket(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$") & F.length(name).between(3, 63), F.lit(False))


def etag(crc: Column, parts: Column | None = None) -> Column:
    """32 lower hex digits; with parts a suffix -N for multipart objects."""
    body = F.lower(F.lpad(F.hex(crc.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 32, "0"))
    return body if parts is None else F.concat(body, F.lit("-"), parts.cast("string"))


def etag_crc(tag: Column) -> Column:
    """The checksum an ETag holds: quotes and -N taken off, low 8 hex digits; null if malformed."""
    bare = F.regexp_replace(F.regexp_replace(tag, '"', ""), "-[0-9]+$", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{8,}$"), F.conv(F.right(bare, F.lit(8)), 16, 10).cast("bigint"))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data.cast("binary")), "+/", "-_"), F.lit("="))


def base64url_text(token: Column) -> Column:
    plain = F.translate(token, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))).cast("string")


def encode_token(key: str) -> str:
    return base64.urlsafe_b64encode(key.encode()).decode().rstrip("=")


def decode_token(token: str) -> str:
    return base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()


def percent_decode(text: Column) -> Column:
    """%xx decoded escape by escape, + kept; what is no escape stays as it is."""
    escapes = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(escapes, F.lit("+"), F.lit("%2B"))), text)


def path_bucket(path: Column) -> Column:
    return F.split(F.ltrim(path, F.lit("/")), "/", 2)[0]


def path_key(path: Column) -> Column:
    return F.coalesce(F.get(F.split(F.ltrim(path, F.lit("/")), "/", 2), F.lit(1)), F.lit(""))


def http_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def human_bytes(size: Column) -> Column:
    """1024-based with 2, 1 or 0 decimals as the number grows; a dash for null."""
    out = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        v = size / float(1024**k)
        shown = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        out = F.when(size >= 1024**k, F.concat(shown, F.lit(" " + unit))).otherwise(out)
    return F.coalesce(out, F.lit("—"))


def human_count(n: Column) -> Column:
    return F.coalesce(F.format_number(n, 0), F.lit("—"))


def relative_age(millis: Column, now: int) -> Column:
    s = F.round(F.abs(F.lit(now) - millis) / 1000)
    shown = (
        F.when(s < 60, F.concat(s.cast("bigint").cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(F.round(s / 60).cast("bigint").cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.round(s / 3600).cast("bigint").cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.round(s / 86400).cast("bigint").cast("string"), F.lit("d ago")))
    )
    return F.when((millis != 0) & millis.isNotNull(), shown).otherwise(F.lit("—"))


def parse_grant(text: Column) -> Column:
    """struct<grantee, ops>: the last colon splits; null where malformed or an operation is unknown."""
    ops = F.transform(F.split(F.regexp_extract(text, ":([^:]*)$", 1), "\\+"), lambda x: F.upper(F.trim(x)))
    fine = text.rlike("^.+:[^:]+$") & F.forall(ops, lambda x: x.isin(OPERATIONS))
    return F.when(fine, F.struct(F.trim(F.regexp_extract(text, "^(.*):[^:]*$", 1)).alias("grantee"), F.array_sort(F.array_distinct(ops)).alias("ops")))


def format_grant(grant: Column) -> Column:
    return F.concat(grant["grantee"], F.lit(":"), F.array_join(F.array_sort(grant["ops"]), "+"))


def principal(text: Column) -> Column:
    """Type:name; a bare name is a User."""
    return F.when(F.instr(text, ":") > 0, text).otherwise(F.concat(F.lit("User:"), text))


def canned_grants(name: Column) -> Column:
    """Grants of a canned ACL as text, joined by commas; null for an unknown one."""
    n = F.lower(F.trim(name))
    return (
        F.when(n.isNull() | n.isin("", "private", "bucket-owner-read", "bucket-owner-full-control"), "")
        .when(n == "public-read", "AllUsers:READ")
        .when(n == "public-read-write", "AllUsers:READ+WRITE")
        .when(n == "authenticated-read", "AuthenticatedUsers:READ")
    )


def permission_operations(name: Column) -> Column:
    n = F.upper(F.trim(name))
    every = F.array(*[F.lit(x) for x in OPERATIONS])
    return F.when(n == "FULL_CONTROL", every).when(n.isin(OPERATIONS[:4]), F.array(n))


def operation_permissions(ops: Column) -> Column:
    every = F.array(*[F.lit(x) for x in OPERATIONS])
    return F.when(F.size(F.array_except(every, ops)) == 0, F.array(F.lit("FULL_CONTROL"))).otherwise(F.filter(every, lambda x: F.array_contains(ops, x) & (x != "ADMIN")))


def user_metadata(headers: Column, prefix: str = "x-amz-meta-") -> Column:
    """Of a map of headers, those with the prefix, without it, in lower case."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.transform_keys(F.map_filter(low, lambda k, v: F.startswith(k, F.lit(prefix))), lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def escape_label(text: Column) -> Column:
    slash = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(slash, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def unescape_label(text: Column) -> Column:
    """\\n is a line break, any other escaped character itself."""
    hold = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    hold = F.replace(hold, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.regexp_replace(hold, r"\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


def register(spark: SparkSession) -> None:
    """The checksum and the ETag as named SQL functions."""
    table = ",".join(f"{x}L" for x in crc32c_table())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION crc32c(data BINARY) RETURNS BIGINT RETURN "
        "aggregate(slice(sequence(0, CAST(length(hex(data)) / 2 AS INT)), 1, CAST(length(hex(data)) / 2 AS INT)), 4294967295L, "
        f"(s, i) -> shiftrightunsigned(s, 8) ^ element_at(array({table}), CAST(((s ^ CAST(conv(substring(hex(data), i * 2 + 1, 2), 16, 10) AS BIGINT)) & 255) + 1 AS INT))) ^ 4294967295L"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION etag(crc BIGINT) RETURNS STRING RETURN lower(lpad(hex(crc & 4294967295L), 32, '0'))")
