"""A folder for tables that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends. Only a
    local master may do without the setting and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the executors of a cluster need a folder they share")
        base = tempfile.mkdtemp(prefix="millrace-")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/millrace/{sc.applicationId}/{uuid.uuid4().hex}")
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()
