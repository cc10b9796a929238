"""Hybrid logical clock: ticks never go back, observed clocks move it forward, far futures are refused."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SKEW_MILLIS = 5 * 60 * 1000


class HybridClock:
    def __init__(self, node: int, wall: Callable[[], int] = lambda: int(time.time() * 1000), max_skew: int = MAX_SKEW_MILLIS):
        self.node, self.wall, self.max_skew = node, wall, max_skew
        self.last = (0, 0)

    def tick(self, count: int = 1) -> tuple[int, int, int]:
        """The first of count consecutive stamps."""
        now = self.wall()
        p, l = (now, 0) if now > self.last[0] else (self.last[0], self.last[1] + 1)
        self.last = (p, l + count - 1)
        return p, l, self.node

    def observe(self, p: int, l: int) -> None:
        if p > self.wall() + self.max_skew:
            raise ValueError("observed clock is too far ahead")
        self.last = max(self.last, (p, l))


def stamp(rows: DataFrame, clock: HybridClock, order: str = "key") -> DataFrame:
    """One tick for a batch: p from the driver, l counted up in key order (per range of keys, then offset)."""
    n = rows.count()
    p, l, node = clock.tick(max(n, 1))
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    inner = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = inner.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = inner.join(F.broadcast(before.drop("_n")), "_part")
    return out.withColumns({"p": F.lit(p).cast("bigint"), "l": (F.lit(l) + F.col("_b") + F.col("_r") - 1).cast("int"), "n": F.lit(node)}).drop("_part", "_r", "_b")
