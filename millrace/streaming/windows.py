"""Streams: last-N windows with state, and last-writer-wins upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.resolve import lww

OUT = "name string, t bigint, id bigint, v double, place int"


class LastN(StatefulProcessor):
    """Keeps the newest n samples of a name by (t, id), whatever order they come in."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "t bigint, id bigint, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        have = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        for df in rows:
            have += list(zip(df["t"].tolist(), df["id"].tolist(), df["v"].tolist()))
            have = sorted(set(have))[-self.n :]  # bounded whatever a batch brings
        self.kept.put(have)
        yield pd.DataFrame([(key[0], t, i, v, k + 1) for k, (t, i, v) in enumerate(have)], columns=["name", "t", "id", "v", "place"])

    def close(self) -> None:
        pass


def last_n(stream: DataFrame, n: int = 60) -> DataFrame:
    """stream (name, t, id, v): on every batch the whole window of the names it touched; a sink replaces by name. Needs the
    RocksDB state store."""
    return stream.select("name", "t", "id", "v").groupBy("name").transformWithStateInPandas(LastN(n), OUT, "update", "none")


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str = "key"):
    """Starts a query that keeps the winners of a stream of facts in a table of versions, for tables of some batches'
    size (see append_upserts for larger ones); batches may arrive in any order
    and again, since the clock decides. The folder of a batch is named by its number, so a retry writes the same."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = lww(batch, key)
        if number > 0:
            new = lww(new.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}")), key)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def append_upserts(stream: DataFrame, path: str, checkpoint: str, key: str = "key"):
    """Starts a query that appends the winners of each batch under the batch's number, so a retry writes the same, and
    work follows the batch and not the table. Read it with current()."""

    def keep(batch: DataFrame, number: int) -> None:
        lww(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def current(spark, path: str, schema: str, key: str = "key") -> DataFrame:
    """The winners of all batches of append_upserts(): merged on reading, in whatever order the batches came."""
    return lww(spark.read.schema(schema + ", batch bigint").parquet(path).drop("batch"), key)


def first_of_tokens(stream: DataFrame, time: str, keep: str, token: str = "token") -> DataFrame:
    """Rows of a stream of requests whose token has not come within the time kept before; state goes with the watermark."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([token])


def tail(spark, path: str, schema: str) -> DataFrame:
    """New files of a log as a stream."""
    return spark.readStream.schema(schema).parquet(path)

