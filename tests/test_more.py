"""Caches with a literal clock, polls of targets, streams of tokens, damage to labels, a cube over odd rows and its memory."""

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions.caches import LruCache, PeriodicGate, TtlCache
from millrace.operators import metrics
from millrace.operators import scan as S
from millrace.plans import extensions
from millrace.plans.catalog import oracle_sql
from millrace.sources import scrape, scratch


def test_caches():
    now = [0]
    c, calls = TtlCache(10, lambda: now[0]), []
    load = lambda: calls.append(1) or len(calls)
    assert [c.get("a", load), c.get("a", load)] == [1, 1]
    now[0] = 10
    assert c.get("a", load) == 2 and len(c) == 1
    c.drop("a")
    assert c.get("a", load) == 3
    with pytest.raises(ZeroDivisionError):
        c.get("b", lambda: 1 / 0)
    assert len(c) == 1
    r = LruCache(2)
    r.put("a", 1), r.put("b", 2), r.get("a"), r.put("c", 3)
    assert (r.get("a"), r.get("b"), r.get("c"), len(r)) == (1, None, 3, 2)
    g = PeriodicGate(5, lambda: now[0])
    assert [g.open(), g.open()] == [True, False]
    now[0] = 15
    assert g.open()


def test_polls_take_one_time_and_fail_alone(spark, tmp_path):
    (tmp_path / "m").write_text('up{a="b"} 1\n')
    rows = scrape.scrape(spark, [f"file://{tmp_path}/m", f"file://{tmp_path}/none"], t=7).orderBy("body").collect()
    assert [r.t for r in rows] == [7, 7] and rows[0].body is None and rows[0].error and rows[1].body == 'up{a="b"} 1\n' and rows[1].error is None
    assert scrape.scrape(spark, []).count() == 0
    q = scrape.scrapes(spark, [f"file://{tmp_path}/m"]).writeStream.format("memory").queryName("polls").trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if spark.table("polls").count() >= 2:
                break
        got = [r.t for r in spark.table("polls").collect()]
        assert len(got) >= 2 and len(set(got)) == len(got)
    finally:
        q.stop()


def test_pages_are_numbered_over_ranges_of_keys(spark):
    rows = S.paged(spark.range(0, 1000, 1, 7).select(F.format_string("%05d", F.hash("id") % 100000 + 100000).alias("key"), "id").dropDuplicates(["key"]), 9).orderBy("key").collect()
    assert [r.page for r in rows] == [1 + k // 9 for k in range(len(rows))]


def test_long_label_values(spark):
    line = 'm{a="' + "x\\n" * 20_000 + '"} 1'
    got = spark.createDataFrame([(line,)], "line string").select(metrics.parse(F.col("line")).alias("s")).first().s
    assert got is not None and len(got.labels["a"]) == 40_000


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def get(self, *_):
            return None

    class Session:
        conf = Nothing()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Nothing)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Session)


def test_cube_over_nulls_and_no_rows(spark, tmp_path):
    columns = "l_returnflag string, l_linestatus string, l_partkey long"
    rows = [("A", "F", 1), ("A", "F", 1), ("A", "O", 1), ("A", None, 2), (None, "F", 2), (None, None, None), ("R", "F", None), ("", "F", -3), ("R", "", 1 << 62)]
    for name, some in (("odd", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, columns).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        want = duckdb.connect().execute(f"WITH lineitem AS (FROM '{at}/lineitem.parquet/*.parquet') " + oracle_sql()["ext_cube"]).fetchall()
        got = [tuple(r) for r in extensions.ext_cube(spark, at).select("flag", "status", "level", "n", "parts").collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and want, name


def test_memory_of_a_task_of_the_cube_does_not_follow_its_rows(spark, tmp_path):
    sc, most = spark.sparkContext, []
    for n in (10_000, 1_000_000):  # one task reads them, each row is of a part of its own
        at = str(tmp_path / str(n))
        spark.range(0, n, 1, 1).select(F.col("id").alias("l_partkey"), (F.col("id") % 3).cast("string").alias("l_returnflag"), (F.col("id") % 2).cast("string").alias("l_linestatus")).write.parquet(f"{at}/lineitem.parquet")
        sc.setJobGroup(at, at)
        rows = extensions.ext_cube(spark, at).collect()
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(rows) == 12 and [(r.n, r.parts) for r in rows if r.level == 3] == [(n, n)]
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store, status = sc._jsc.sc().statusStore(), sc.statusTracker()
        tasks = [store.taskList(k, 0, 1000) for job in status.getJobIdsForGroup(at) for k in status.getJobInfo(job).stageIds]
        most.append(max(x.apply(i).taskMetrics().get().peakExecutionMemory() for x in tasks for i in range(x.size())))
    assert 0 < most[1] < 1.5 * most[0], most
