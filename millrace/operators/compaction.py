"""Flushes and compactions as batch jobs, garbage by reference, sweeps with a literal clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import DELETE, lww, shadow

L0_TRIGGER, L0_STALL, LEVEL_BYTES, LEVEL_GROWTH = 4, 12, 10 << 20, 10
GRACE_MILLIS, ABANDON_MILLIS = 24 * 3600 * 1000, 60_000


def table_statistics(rows: DataFrame, by: str, key: str = "key", size: str = "bytes", blob: str = "blob") -> DataFrame:
    """min_key, max_key, entries, bytes and number of distinct blobs of each table."""
    return rows.groupBy(by).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entries"), F.sum(size).cast("bigint").alias("bytes"), F.count_distinct(blob).alias("blobs"))


def level_statistics(tables: DataFrame) -> DataFrame:
    return tables.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))


def level_scores(tables: DataFrame, base: int = LEVEL_BYTES, growth: int = LEVEL_GROWTH) -> DataFrame:
    """level >= 1, bytes, score: bytes over the level's budget."""
    s = level_statistics(tables).where("level >= 1")
    return s.select("level", "bytes", (F.col("bytes") / (F.lit(float(base)) * F.pow(F.lit(float(growth)), F.col("level") - 1))).alias("score"))


def pick_level(tables: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BYTES, growth: int = LEVEL_GROWTH) -> DataFrame:
    """One row: the level to compact (0 if it has too many files, else the most over budget, ties to the lowest); null if none."""
    l0 = tables.where("level = 0").agg(F.count("*").alias("n"))
    over = level_scores(tables, base, growth).where("score > 1").agg(F.max_by("level", F.struct("score", (-F.col("level")).alias("_t"))).alias("best"))
    return l0.crossJoin(over).select(F.when(F.col("n") >= trigger, F.lit(0)).otherwise(F.col("best")).cast("int").alias("level"))  # one row each


def overlapping(tables: DataFrame, low: str, high: str) -> DataFrame:
    """Tables whose key range meets [low, high]."""
    return tables.where((F.col("min_key") <= high) & (F.col("max_key") >= low))


def hull(tables: DataFrame, level: int) -> DataFrame:
    """One row: the least and greatest key of a level's tables."""
    return tables.where(F.col("level") == level).agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))


def level_stalled(tables: DataFrame, by: str, limit: int = L0_STALL) -> DataFrame:
    """by, files, stalled: whether writers of each partition must wait for a compaction."""
    n = tables.groupBy(by).agg(F.count_if(F.col("level") == 0).alias("files"))
    return n.withColumn("stalled", F.col("files") >= limit)


def pick_inputs(tables: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BYTES, growth: int = LEVEL_GROWTH) -> tuple[list, int, bool] | None:
    """(tables, output level, bottommost) on the driver, from table metadata; None if nothing is due."""
    level = pick_level(tables, trigger, base, growth).first()[0]
    if level is None:
        return None
    mine = tables.where(F.col("level") == level).orderBy("ledger")
    seed = mine.collect() if level == 0 else mine.limit(1).collect()
    low, high = hull(tables.join(tables.sparkSession.createDataFrame([(t.ledger,) for t in seed], "ledger long"), "ledger", "left_semi"), level).first()
    more = overlapping(tables.where(F.col("level") == level + 1), low, high).collect()
    return [*seed, *more], level + 1, tables.where(F.col("level") > level + 1).isEmpty()


def compact(facts: DataFrame, ranges: DataFrame, bottommost: bool, now: int, grace: int = GRACE_MILLIS, micros: bool = False) -> tuple[DataFrame, DataFrame]:
    """Winners and range deletions that the new table holds.

    Only a bottommost compaction drops: point tombstones created at least grace ago, and range deletions of that age with
    the points they cover. Everything else is carried on. ranges must be those all of whose overlapping tables are inputs.
    """
    winners = lww(facts)
    if not bottommost:
        return winners, ranges
    unit = 1000 if micros else 1
    aged = F.col("p") <= (now - grace) * unit
    old = ranges.where(aged)
    keep = winners.where(~((F.col("type") == DELETE) & (F.col("created_at") <= now - grace)))
    return shadow(keep, old), ranges.where(~aged)


def aged(millis: Column, now: int, ttl: int) -> Column:
    return millis <= now - ttl


def referenced(*references: DataFrame) -> DataFrame:
    """Distinct blobs of any of the references (each with a column blob)."""
    return reduce(DataFrame.union, [r.select("blob") for r in references]).distinct()


def orphans(blobs: DataFrame, *references: DataFrame) -> DataFrame:
    return blobs.select("blob").distinct().join(referenced(*references), "blob", "left_anti")


def reclaimable(own_orphans: DataFrame, *foreign: DataFrame) -> DataFrame:
    """Orphans of a partition that no other partition of the bucket refers to."""
    return own_orphans.join(referenced(*foreign), "blob", "left_anti")


def expired_uploads(uploads: DataFrame, now: int, ttl: int) -> DataFrame:
    return uploads.where(aged(F.col("created_at"), now, ttl))


def abort(uploads: DataFrame, aborted: DataFrame) -> DataFrame:
    """Uploads left; aborting twice is fine."""
    return uploads.join(aborted.select("upload_id").distinct(), "upload_id", "left_anti")


def sweep_intents(intents: DataFrame, markers: DataFrame, now: int, abandon: int = ABANDON_MILLIS) -> DataFrame:
    """token, action: finish where the copy's marker is there, drop where it never came, wait else."""
    m = markers.select("token").distinct().withColumn("_there", F.lit(True))
    both = intents.join(m, "token", "left")
    action = F.when(F.col("_there"), "finish").when(aged(F.col("created_at"), now, abandon), "drop").otherwise("wait")
    return both.select("token", action.alias("action"))


def stalled(tables: DataFrame, limit: int = L0_STALL) -> bool:
    return tables.where("level = 0").count() >= limit


def replay(edits: DataFrame) -> DataFrame:
    """Tables left after manifest edits (seq, op add/remove, ledger, ...): the last edit of a ledger decides."""
    rest = [c for c in edits.columns if c not in ("ledger", "seq")]
    last = edits.groupBy("ledger").agg(F.max(F.struct("seq", *rest)).alias("_w")).where("_w.op = 'add'")
    return last.select("ledger", *[F.col("_w")[c].alias(c) for c in rest if c != "op"])


