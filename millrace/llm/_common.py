"""What the operators share: written tables in the shared folder, joins behind a size check, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many ids (16 bytes each in Spark's map of longs) may be broadcast; beyond it, both sides shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes of an Arrow batch within small_batches(). Spark's own bounds, 10,000 rows or 64 MB, hold several times a batch of
#: whole texts in the JVM, outside its heap, and once or twice more in the Python worker, for each task.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for written tables: spark.checkpoint.dir of the session. Only a local master may do without;
    it then gets a temporary folder, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.millrace.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors of a cluster need a folder they share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.dir", found)
    return found.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    """The folder of this application's written tables, which goes when the driver's JVM ends."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/millrace/{sc.applicationId}"
    if path not in _marked:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _marked.add(path)
    return path


_marked: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet in the shared folder and reads them again. The files go when the
    application ends, or with forget()."""
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(df._written_at).getParent()
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is run within goes to Python workers in batches of about size bytes (a longer row stands alone), unless the
    session sets a bound itself. The bound is read when a plan is run, so the result must be written within."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name in spark.conf.getAll:
        yield
        return
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name)


def only_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df with (left_semi) or without (left_anti) an id of a written table. The ids are counted first: a small
    table is broadcast, so that the long rows of df stay where they are; beyond the limit both sides are shuffled."""
    small = ids.count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of edges (a, b: long), as (id, component).

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum joined back, so a hub
    is a skewed join and never one task's list; every step is written, so a lost executor costs one step, and the
    table of the step before is deleted. Ends when a step changes nothing. Null ends and loops are ignored. Nodes without edges are not in the result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    now = state(e)
    while now[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, e = e, written(small, "edges")
        forget(before)
        then, now = now, state(e)
        if then == now:
            break
    roots = e.groupBy("b").agg(F.lit(0)).select(F.col("b").alias("id"), F.col("b").alias("component"))
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(roots)


def sized_join(df: DataFrame, edits: DataFrame, key: str = "doc_id", limit: int = BROADCAST_IDS // 16) -> DataFrame:
    """df with the columns of a written table that has at most one row a key. Few rows are broadcast after they are
    counted, so that long texts stay where they are; beyond the limit both sides are shuffled."""
    return df.join(F.broadcast(edits) if edits.count() <= limit else edits.hint("merge"), key, "left")
