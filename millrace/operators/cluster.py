"""Who holds which partition, and who should: queries over leases and members, counters, storage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_MOVES = 4


def partitions(buckets: DataFrame) -> DataFrame:
    """bucket, part for each partition of each bucket."""
    return buckets.select("bucket", F.explode(F.sequence(F.lit(0), F.col("partition_count") - 1)).alias("part"))


def ownership(members: DataFrame, leases: DataFrame) -> DataFrame:
    """node, address, owned: partitions held by each member, members without any too."""
    n = leases.groupBy("node").agg(F.count("*").alias("owned"))
    return members.join(n, "node", "left").select("node", "address", F.coalesce("owned", F.lit(0)).alias("owned"))


def ownerless(buckets: DataFrame, leases: DataFrame) -> DataFrame:
    """Buckets of which a partition has no holder, with how many."""
    free = partitions(buckets).join(leases.select("bucket", "part").distinct(), ["bucket", "part"], "left_anti")
    return free.groupBy("bucket").agg(F.count("*").alias("free"))


def owners(buckets: DataFrame, leases: DataFrame) -> DataFrame:
    """bucket, owners: distinct holders in order, joined by commas."""
    each = leases.groupBy("bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_set("node")), lambda x: x.cast("string")), ",").alias("owners"))
    return buckets.select("bucket").join(each, "bucket", "left").select("bucket", F.coalesce("owners", F.lit("")).alias("owners"))


def sticky(parts: DataFrame, members: DataFrame, leases: DataFrame) -> DataFrame:
    """bucket, part, node (live holder or null), state: keep within the fair share, overflow beyond it, unowned else."""
    live = leases.join(members.select("node").distinct(), "node", "left_semi").select("bucket", "part", "node")
    sizes = parts.agg(F.count("*").alias("_p")).crossJoin(members.agg(F.count_distinct("node").alias("_m")))  # one row each
    held = parts.join(live, ["bucket", "part"], "left").crossJoin(F.broadcast(sizes))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("bucket", "part"))
    share = F.ceil(F.col("_p") / F.greatest(F.col("_m"), F.lit(1)))
    state = F.when(F.col("node").isNull(), "unowned").when(rank <= share, "keep").otherwise("overflow")
    return held.select("bucket", "part", "node", state.alias("state"))


def balance(parts: DataFrame, members: DataFrame, leases: DataFrame, moves: int = MAX_MOVES) -> DataFrame:
    """bucket, part, node: the assignment of a round. Holders keep their fair share; unowned partitions go to the least
    loaded member, then at most so many of the overflow. The greedy part is sequential by nature and runs over the
    partitions it concerns: metadata, a few rows a bucket."""
    table = sticky(parts, members, leases)
    keep = table.where("state = 'keep'")
    load = {r["node"]: 0 for r in members.select("node").distinct().collect()}
    if not load:
        return table.select("bucket", "part", "node").limit(0)
    for r in keep.groupBy("node").count().collect():
        load[r["node"]] = r["count"]
    placed = []
    rest = table.where("state <> 'keep'").orderBy(F.when(F.col("state") == "unowned", 0).otherwise(1), "bucket", "part").collect()
    for r in rest:
        node = r["node"]
        if r["state"] == "unowned" or moves > 0:
            moves -= r["state"] == "overflow"
            node = min(load, key=lambda k: (load[k], k))
        load[node] += 1
        placed.append((r["bucket"], r["part"], node))
    kept = keep.select("bucket", "part", "node")
    return kept.union(parts.sparkSession.createDataFrame(placed, kept.schema)) if placed else kept


def least_loaded(loads: DataFrame) -> DataFrame:
    """One row: the member of least load, ties to the smallest."""
    return loads.agg(F.min_by("node", F.struct("load", "node")).alias("node"))


def counters(events: DataFrame, op: Column, by: str, names: list[str]) -> DataFrame:
    """A count for each operation name, by partition."""
    return events.groupBy(by).agg(*[F.count_if(op == x).alias(x) for x in names])


def storage_totals(tables: DataFrame, columns: list[str]) -> DataFrame:
    """Sums with null as 0."""
    return tables.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint").alias(c) for c in columns])


def name_filter(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.contains(F.lower(column), F.lit(text.lower())))
