"""Extensions: what Spark gives beyond the key space, one query for each category, over the same tables and the live view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import fixtures as X
from .catalog import live, query

#: Parts are dealt to so many tasks: the most that Spark writes without holding rows (spark.shuffle.sort.bypassMergeThreshold).
_TASKS = 200


@query("SELECT c_mktsegment AS segment, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderkey IS NULL) AS without FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def ext_left_join(s, d):
    c, o = X.table(s, d, "customer"), X.table(s, d, "orders").select("o_orderkey", "o_custkey")
    both = c.select("c_custkey", "c_mktsegment").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("o_orderkey").alias("n_orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("SELECT coalesce(n_name, '?') AS nation, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM nation FULL JOIN (SELECT c_custkey, c_nationkey, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_nationkey, s_suppkey FROM supplier) ON n_nationkey = c_nationkey GROUP BY 1")
def ext_full_join(s, d):
    c = X.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.lit(None).cast("bigint").alias("s_suppkey"))
    u = X.table(s, d, "supplier").select(F.lit(None).cast("bigint").alias("c_custkey"), F.col("s_nationkey").alias("k"), "s_suppkey")
    both = X.table(s, d, "nation").join(c.union(u), F.col("n_nationkey") == F.col("k"), "full")
    return both.groupBy(F.coalesce("n_name", F.lit("?")).alias("nation")).agg(F.count("c_custkey").alias("customers"), F.count("s_suppkey").alias("suppliers"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")
def ext_semi_anti_join(s, d):
    o = X.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    c = X.table(s, d, "customer").select("c_custkey")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '5-LOW'"), "c_custkey", "left_anti")


_ASOF = "WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), e AS (SELECT user_id, event_id AS error_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error') "


@query(_ASOF + "SELECT c.event_id AS event_id, arg_max(e.error_id, (e.t, e.error_id)) AS error_id FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.t <= c.t GROUP BY c.event_id")
def ext_asof_join(s, d):
    """Each click with the last error of its user before it: both sides in one window, no join."""
    e = X.table(s, d, "events").where("event_type in ('click', 'error')")
    error = F.when(F.col("event_type") == "error", F.struct(F.col("ts"), "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last", F.max(error).over(w)).where("event_type = 'click'").select("event_id", F.col("last.event_id").alias("error_id"))


@query("SELECT p_partkey, count(*) AS n FROM part JOIN (VALUES (1, 10, 'a'), (8, 25, 'b'), (20, 51, 'c')) r(low, high, name) ON p_size >= low AND p_size < high GROUP BY 1")
def ext_range_join(s, d):
    """Parts in overlapping ranges of sizes; three ranges are broadcast."""
    r = s.createDataFrame([(1, 10, "a"), (8, 25, "b"), (20, 51, "c")], "low int, high int, name string")
    p = X.table(s, d, "part").select("p_partkey", "p_size")
    return p.join(F.broadcast(r), (F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high"))).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, grouping(l_returnflag) + 2 * grouping(l_linestatus) AS level, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(s, d):
    """Rows of a part meet in one task before they are grouped and taken into the four sets: no task holds four of each row it reads, as with cube()."""
    i = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("t"), F.col("l_partkey").alias("part"))
    i = i.repartition(_TASKS, "part").groupBy("part", "f", "t").agg(F.count("*").alias("n"))
    sets = [F.struct(F.lit(k).cast("bigint").alias("level"), F.when(F.lit(not k & 1), F.col("f")).alias("flag"), F.when(F.lit(not k & 2), F.col("t")).alias("status")) for k in range(4)]
    i = i.select("part", "n", F.inline(F.array(*sets))).groupBy("part", "level", "flag", "status").agg(F.sum("n").alias("n"))
    none = s.range(0, 1, 1, 1).select(F.lit(None).alias("part"), F.lit(3).alias("level"), F.lit(None).alias("flag"), F.lit(None).alias("status"), F.lit(0).alias("n"))  # a table without rows has its total
    return i.union(none).groupBy("flag", "status", "level").agg(F.sum("n").alias("n"), F.count("part").alias("parts"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def ext_rollup(s, d):
    return X.table(s, d, "orders").rollup(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS place, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS recent, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def ext_windows(s, d):
    """Ranks, a frame of 90 days, and the order before."""
    by = Window.partitionBy("o_custkey")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return X.table(s, d, "orders").select("o_orderkey", F.rank().over(by.orderBy(F.col("o_totalprice").desc())).cast("bigint").alias("place"), F.count("*").over(by.orderBy(day).rangeBetween(-90, 0)).alias("recent"), F.lag("o_orderkey").over(by.orderBy("o_orderdate", "o_orderkey")).alias("before"))


@query("(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def ext_set_operations(s, d):
    o, c = X.table(s, d, "orders"), X.table(s, d, "customer")
    k = o.select(F.col("o_custkey").alias("k"))
    return k.intersect(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).subtract(o.where("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(s, d):
    e = X.table(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("event_type", F.unix_micros("window.start").alias("day"), "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS began, count(*) AS n FROM h GROUP BY user_id, k"
)
def ext_session_window(s, d):
    e = X.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("began"), "n")


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS price, CAST(date_diff('day', l_shipdate, l_shipdate + INTERVAL 1 MONTH) AS INTEGER) AS days, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem")
def ext_types(s, d):
    """Decimals, dates and intervals."""
    i = X.table(s, d, "lineitem")
    ship = F.col("l_shipdate").cast("date")
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return i.select("l_orderkey", "l_linenumber", price.cast("double").alias("price"), F.datediff(F.add_months(ship, 1), ship).alias("days"), F.year(ship).alias("y"))


_TEXT = "SELECT substr(key, 1, 8) AS user, count(*) AS n, CAST(sum(len) AS BIGINT) AS len FROM {0} WHERE len > (SELECT avg(len) FROM {0}) GROUP BY 1"


@query(X.KEYSPACE + _TEXT.format("live"))
def ext_sql_over_live_view(s, d):
    """SQL text with a subquery over the live view."""
    live(s, d).createOrReplaceTempView("live_objects")
    return s.sql(_TEXT.format("live_objects"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM documents")
def ext_pandas_udf(s, d):
    """A function of Python over Arrow batches."""
    @F.pandas_udf("bigint")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda x: len((x or "").encode().split()))

    return X.table(s, d, "documents").select("doc_id", words("text").alias("n"))


@query("SELECT event_id, unnest(range(0, event_id % 4)) AS k FROM events")
def ext_table_function(s, d):
    """A table function of Python, joined laterally."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="k bigint")
    class Upto:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    s.udtf.register("upto", Upto)
    X.table(s, d, "events").select("event_id").createOrReplaceTempView("some_events")
    return s.sql("SELECT event_id, k FROM some_events, LATERAL upto(event_id % 4)")
