"""Metrics scraped from targets, as a Spark data source: one row a target and poll, (t, target, body, error).

A poll takes one time for all its targets. Each target is read on an executor by itself, and one that fails gives a row
with an error and no body. Batch reads poll once; streams poll once a micro-batch, so the trigger is the rate and the
first poll is at once. Targets are URLs that urllib can open.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "t bigint, target string, body string, error string"


class Target(InputPartition):
    def __init__(self, url: str, t: int, timeout: float):
        self.url, self.t, self.timeout = url, t, timeout


def poll(target: Target | None) -> Iterator[tuple]:
    from urllib.request import urlopen

    if target is None:  # without any target Spark reads one empty partition
        return
    try:
        with urlopen(target.url, timeout=target.timeout) as got:
            yield target.t, target.url, got.read().decode("utf-8", "replace"), None
    except Exception as error:  # the other targets go on
        yield target.t, target.url, None, str(error)


class _Targets:
    def __init__(self, options):
        self.urls = [u for u in options.get("targets", "").split("\n") if u]
        self.timeout = float(options.get("timeout", 5))
        self.fixed = options.get("time")

    def due(self, t: int) -> list[Target]:
        return [Target(u, t, self.timeout) for u in self.urls]

    def now(self) -> int:
        return int(self.fixed or time.time() * 1000)


class _Batch(_Targets, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.due(self.now())

    def read(self, partition: Target) -> Iterator[tuple]:
        return poll(partition)


class _Stream(_Targets, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"t": 0}

    def latestOffset(self) -> dict:
        return {"t": self.now()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.due(end["t"]) if end["t"] > start["t"] else []

    def read(self, partition: Target) -> Iterator[tuple]:
        return poll(partition)


class Scrape(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scrape"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _options(spark: SparkSession, reader, targets: list[str], timeout: float, t: int | None):
    spark.dataSource.register(Scrape)
    got = reader.format("scrape").option("targets", "\n".join(targets)).option("timeout", timeout)
    return got if t is None else got.option("time", t)


def scrape(spark: SparkSession, targets: list[str], timeout: float = 5, t: int | None = None) -> DataFrame:
    """Polls all targets once."""
    return _options(spark, spark.read, targets, timeout, t).load()


def scrapes(spark: SparkSession, targets: list[str], timeout: float = 5) -> DataFrame:
    """A stream of polls; start it with trigger(processingTime=..)."""
    return _options(spark, spark.readStream, targets, timeout, None).load()
