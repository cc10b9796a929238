"""Writes as facts: each function gives rows to append to a log; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import DELETE, PUT, live


def first_of_token(requests: DataFrame, token: str = "token", seq: str = "seq") -> DataFrame:
    """Of requests with one token the first; requests without a token stand each alone."""
    rest = [c for c in requests.columns if c not in (token, seq)]
    kept = requests.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(F.struct(seq, *rest)).alias("_w"))
    kept = kept.select(*[F.col(c) if c == token else F.col("_w")[c].alias(c) for c in requests.columns])
    return kept.unionByName(requests.where(F.col(token).isNull()))


def delete(keys: DataFrame, p: Column, l: Column, n: Column, like: list[str]) -> DataFrame:
    """Tombstones; a key need not exist. like: columns of the log, those not known are null."""
    have = {"key": F.col("key"), "p": p, "l": l, "n": n, "type": F.lit(DELETE)}
    return keys.select(*[have.get(c, F.lit(None)).alias(c) for c in like])


def delete_range(start: str | None, end: str | None, spark, p: int, l: int, n: int) -> DataFrame:
    if start is not None and end is not None and not start.encode() < end.encode():
        raise ValueError("start must lie before end")
    return spark.createDataFrame([(start, end, p, l, n)], "s string, e string, p long, l int, n int")


def delete_prefix(prefix: str, spark, p: int, l: int, n: int) -> DataFrame:
    """One range fact; an empty prefix is the whole bucket."""
    from ..functions.keys import prefix_successor

    above = prefix_successor(prefix.encode()) if prefix else None
    return delete_range(prefix or None, above.decode() if above else None, spark, p, l, n)


def copy(view: DataFrame, pairs: DataFrame, p: Column, l: Column, n: Column, created: Column, rename: bool = False) -> DataFrame:
    """pairs (src, dst): puts at dst that take the bytes of the live src as they are. A copy gets a new creation time and
    no grants; a rename keeps grants and adds a tombstone at src with a later clock. An absent src gives no row; src = dst
    is refused by leaving it out."""
    src = view.join(pairs.where("src <> dst"), F.col("key") == F.col("src"))
    new = {"key": F.col("dst"), "p": p, "l": l, "n": n, "type": F.lit(PUT), "created_at": created}
    if not rename:
        new |= {c: F.lit(None) for c in ("owner", "grants") if c in view.columns}
    out = src.select(*[new[c].cast(view.schema[c].dataType).alias(c) if c in new else F.col(c) for c in view.columns])
    if not rename:
        return out
    gone = {"key": F.col("src"), "p": p, "l": l + 1, "n": n, "type": F.lit(DELETE)}
    return out.unionByName(src.select(*[gone[c].cast(view.schema[c].dataType).alias(c) if c in gone else F.lit(None).cast(view.schema[c].dataType).alias(c) for c in view.columns]))


def set_grants(view: DataFrame, changes: DataFrame, p: Column, l: Column, n: Column) -> DataFrame:
    """changes (key, new_grants): the live fact with new grants and clock; creation time and bytes stay."""
    src = view.join(changes, "key")
    new = {"p": p, "l": l, "n": n, "grants": F.col("new_grants")}
    return src.select(*[new[c].cast(view.schema[c].dataType).alias(c) if c in new else F.col(c) for c in view.columns])


def grant(grants: Column, grantee: Column, ops: Column) -> Column:
    """Adds or replaces the entry of one grantee."""
    others = F.filter(F.coalesce(grants, F.array().cast("array<struct<grantee:string,ops:array<string>>>")), lambda g: g["grantee"] != grantee)
    return F.concat(others, F.array(F.struct(grantee.alias("grantee"), ops.alias("ops"))))


def revoke(grants: Column, grantee: Column) -> Column:
    return F.filter(grants, lambda g: g["grantee"] != grantee)


def conditional_delete(view: DataFrame, wanted: DataFrame, p: Column, l: Column, n: Column, like: list[str]) -> DataFrame:
    """wanted (key, ep, el, en): tombstones for keys whose live fact has exactly that clock."""
    same = view.join(wanted, "key").where((F.col("p") == F.col("ep")) & (F.col("l") == F.col("el")) & (F.col("n") == F.col("en")))
    return delete(same.select("key"), p, l, n, like)


def batch_delete(keys: DataFrame, quiet: bool = False) -> DataFrame:
    """keys (key and whatever else) with status: invalid keys are errors; successes are hidden when quiet."""
    from ..functions.keys import valid_key

    out = keys.select("*", F.when(valid_key(F.col("key")), "deleted").otherwise("error").alias("status"))
    return out.where("status = 'error'") if quiet else out


def admit_uploads(requests: DataFrame, open_uploads: DataFrame, most: int, by: str = "bucket", order: str = "upload_id") -> DataFrame:
    """requests with status: ok, or busy beyond so many uploads in flight of a bucket. Requests are admitted in order; a
    bucket has few in flight, so its window is small, and requests keep all their columns (metadata too)."""
    flying = open_uploads.groupBy(by).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    out = requests.join(flying, by, "left").withColumn("status", F.when(rank + F.coalesce("_n", F.lit(0)) <= most, "ok").otherwise("busy"))
    return out.drop("_n")


def bucket_is_empty(facts: DataFrame, ranges: DataFrame) -> bool:
    """Whether a bucket may be dropped without force: no live object."""
    return live(facts, ranges).limit(1).isEmpty()
