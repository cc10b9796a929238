"""Roll-up of keys at a delimiter, versions, multipart listings, result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to the first delimiter after the prefix, with it; null if there is none."""
    rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
    at = F.instr(rest, delimiter)
    return F.when(at > 0, F.substring(key, F.lit(1), F.lit(len(prefix)) + at + len(delimiter) - 1))


def roll_up(rows: DataFrame, prefix: str = "", delimiter: str = "/", key: str = "key", size: str | None = None) -> DataFrame:
    """entry, is_prefix, n (keys under it), and with size the sum of it: rows and common prefixes as one listing."""
    inside = rows.where(F.startswith(key, F.lit(prefix))) if prefix else rows
    cp = common_prefix(F.col(key), prefix, delimiter) if delimiter else F.lit(None).cast("string")
    each = inside.select(F.coalesce(cp, key).alias("entry"), cp.isNotNull().alias("is_prefix"), *([size] if size else []))
    total = [F.sum(size).alias(size)] if size else []
    return each.groupBy("entry", "is_prefix").agg(F.count("*").alias("n"), *total)


def versions(live: DataFrame, key: str = "key") -> DataFrame:
    """Each live object once, as its only and latest version."""
    return live.withColumns({"version_id": F.lit("null"), "is_latest": F.lit(True)})


def version_page(live: DataFrame, prefix: str = "", delimiter: str = "", key_marker: str | None = None, limit: int = 1000, key: str = "key") -> DataFrame:
    """entry, is_prefix, version_id, is_latest: a page of versions and common prefixes, after the marker. A marker that
    ends in the delimiter is a common prefix and leaves out all keys under it."""
    rows = live if key_marker is None else live.where(F.col(key) > key_marker)
    if key_marker is not None and delimiter and key_marker.endswith(delimiter):
        rows = rows.where(~F.startswith(key, F.lit(key_marker)))
    got = roll_up(rows, prefix, delimiter, key).orderBy("entry").limit(limit)
    one = ~F.col("is_prefix")
    return got.select("entry", "is_prefix", F.when(one, "null").alias("version_id"), F.when(one, F.lit(True)).alias("is_latest"))


def uploads(df: DataFrame, prefix: str = "", key_marker: str | None = None, upload_marker: str | None = None, limit: int = 1000) -> DataFrame:
    """Uploads in flight by (key, upload_id), after the markers; sorted before it is cut."""
    out = df.where(F.startswith("key", F.lit(prefix))) if prefix else df
    if key_marker is not None:
        after = F.col("key") > key_marker
        if upload_marker is not None:
            after |= (F.col("key") == key_marker) & (F.col("upload_id") > upload_marker)
        out = out.where(after)
    return out.orderBy("key", "upload_id").limit(limit)


def parts(df: DataFrame, upload_id, marker: int = 0, limit: int = 1000) -> DataFrame:
    return df.where((F.col("upload_id") == upload_id) & (F.col("part_number") > marker)).orderBy("part_number").limit(limit)


def merged_uploads(*partitions: DataFrame, limit: int = 1000) -> DataFrame:
    out = partitions[0]
    for p in partitions[1:]:
        out = out.unionByName(p)
    return out.orderBy("key", "upload_id").limit(limit)


def as_tsv(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def as_xml(df: DataFrame, row: str = "Contents") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias("line"))
