"""Last writer wins: the newest fact of each key by hybrid logical clock (p, l, n), and what deletions hide.

The winner is a grouped maximum of a struct, combined before the shuffle, so a hot key costs one row a task. A filter on
the key is pushed through the aggregate to the scan. Tombstones are filtered after the maximum, never before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE = 1, 2
CLOCK = ["p", "l", "n"]
#: Of so many range deletions at most a nested-loop join may broadcast; beyond, and where keys share prefixes, hash joins.
BROADCAST_RANGES = 100
LEVELS = (32, 16, 8, 4, 2, 1)


def clock(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in CLOCK])


def lww(facts: DataFrame, key: str | list[str] = "key", order: list[str] | None = None) -> DataFrame:
    """One row a key: the fact of the greatest clock. Other columns but maps break ties of equal clocks, in
    their order."""
    keys = [key] if isinstance(key, str) else key
    first = order or CLOCK
    rest = [c for c in facts.columns if c not in keys and c not in first]
    whole = F.struct(*first, *rest)
    ordered = [c for c in rest if "map<" not in facts.schema[c].dataType.simpleString()]  # maps have no order
    newest = F.max(whole) if len(ordered) == len(rest) else F.max_by(whole, F.struct(*first, *ordered))
    best = facts.groupBy(*keys).agg(newest.alias("_w"))
    return best.select(*[F.col(c) if c in keys else F.col("_w")[c].alias(c) for c in facts.columns])


def merge(*sources: DataFrame, key: str = "key") -> DataFrame:
    """Merged view of several sorted or unsorted sources: union, then last writer wins."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return lww(out, key)


def _covers(key: Column) -> Column:
    return (F.col("_s").isNull() | (key >= F.col("_s"))) & (F.col("_e").isNull() | (key < F.col("_e")))


def _levelled(ranges: DataFrame) -> DataFrame:
    """Range deletions with the length of a prefix that all their keys share, rounded down to a level (0: none)."""
    r = ranges.select(F.col("s").alias("_s"), F.col("e").alias("_e"), clock().alias("_c"))
    places = F.sequence(F.lit(1), F.least(F.length("_s"), F.length("_e")))
    shared = F.when(F.least(F.length("_s"), F.length("_e")) > 0, F.size(F.filter(places, lambda i: F.substring("_s", F.lit(1), i) == F.substring("_e", F.lit(1), i)))).otherwise(0)
    # [abc, abd) has keys of prefix abc only, though the bounds share but ab
    level = F.lit(0)
    for k in reversed(LEVELS):
        level = F.when(F.coalesce(shared, F.lit(0)) >= k, F.lit(k)).otherwise(level)
    return r.withColumn("_level", level)


def shadow(rows: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """Rows that no strictly newer range deletion covers (a theta anti join).

    Few range deletions (counted) are broadcast. Otherwise those whose bounds share a prefix are hash joined on it, level
    by level, and only the rest is compared with all rows.
    """
    newer = F.col("_c") > clock()
    if ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES:
        r = ranges.select(F.col("s").alias("_s"), F.col("e").alias("_e"), clock().alias("_c"))
        return rows.join(F.broadcast(r), _covers(F.col(key)) & newer, "left_anti")
    r = _levelled(ranges)
    out = rows
    for k in sorted((x[0] for x in r.select("_level").distinct().collect()), reverse=True):  # seven levels at most
        of = r.where(F.col("_level") == k)
        same = F.substring(key, 1, k) == F.substring("_s", 1, k) if k else F.lit(True)
        out = out.join(of, same & _covers(F.col(key)) & newer, "left_anti")
    return out


def shadowed(rows: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """The rows that a newer range deletion hides."""
    r = _levelled(ranges)
    parts = []
    for k in [x[0] for x in r.select("_level").distinct().collect()]:
        same = F.substring(key, 1, k) == F.substring("_s", 1, k) if k else F.lit(True)
        parts.append(rows.join(r.where(F.col("_level") == k), same & _covers(F.col(key)) & (F.col("_c") > clock()), "left_semi"))
    out = rows.limit(0)
    for p in parts:
        out = out.union(p)
    return out.distinct()


def max_covering(rows: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """key and the greatest clock (cp, cl, cn) of the range deletions that cover it, whatever their age; covered keys only."""
    keys = rows.select(key).distinct()
    r = _levelled(ranges)
    best = None
    for k in [x[0] for x in r.select("_level").distinct().collect()]:
        same = F.substring(key, 1, k) == F.substring("_s", 1, k) if k else F.lit(True)
        part = keys.join(r.where(F.col("_level") == k), same & _covers(F.col(key))).groupBy(key).agg(F.max("_c").alias("_m"))
        best = part if best is None else best.union(part)
    if best is None:
        best = keys.limit(0).withColumn("_m", F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).alias("l"), F.lit(0).alias("n")))
    return best.groupBy(key).agg(F.max("_m").alias("m")).select(key, F.col("m.p").alias("cp"), F.col("m.l").alias("cl"), F.col("m.n").alias("cn"))


def live(facts: DataFrame, ranges: DataFrame | None = None, key: str = "key") -> DataFrame:
    """The current objects: winners that are puts and that no newer range deletion covers."""
    out = lww(facts, key).where(F.col("type") == PUT)
    return out if ranges is None else shadow(out, ranges, key)


def max_clock(*logs: DataFrame) -> DataFrame:
    """The greatest clock over logs of point and range facts (one row; nulls if all are empty)."""
    every = logs[0].select(*CLOCK)
    for x in logs[1:]:
        every = every.union(x.select(*CLOCK))
    return every.agg(F.max(F.struct(*CLOCK)).alias("m")).select("m.p", "m.l", "m.n")
