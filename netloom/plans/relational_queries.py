"""Relational coverage over the star tables, event windows, and learned heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import heads
from ..sources.tables import table
from ..streaming import events as streams
from .netlist_queries import _labels, slacks
from ..operators.features import labels as label_table, node_features


def _micros(column: str):
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def star_join_agg(spark, sf_dir) -> DataFrame:
    """Revenue and orders of each nation and segment."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def semi_anti(spark, sf_dir):
    """Customers with and without an order above the given price."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    on = c.c_custkey == o.o_custkey
    a, b = (c.join(o, on, how).groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit(how)) for how in ("left_semi", "left_anti"))
    return a.unionByName(b)


def setops(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    parts, sold = p.select(F.col("p_partkey").alias("k")), li.where("l_quantity >= 45").select(F.col("l_partkey").alias("k"))
    out = [("union", parts.union(sold).distinct()), ("intersect", parts.intersect(sold)), ("except", parts.exceptAll(sold.distinct()))]
    rows = [d.agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("op", F.lit(n)) for n, d in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"))


def window_frames(spark, sf_dir):
    """Running and trailing sums of each user's events, and the gap to the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("trailing"), (_micros("ts") - F.lag(_micros("ts")).over(w)).alias("gap_us"), F.ntile(4).over(w).cast("long").alias("quarter"))


def events_tumbling(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"), "6 hours").select(_micros("start").alias("start_us"), "event_type", "n", "total")


def events_sliding(spark, sf_dir):
    return streams.sliding(table(spark, sf_dir, "events"), "1 day", "6 hours").select(_micros("start").alias("start_us"), "event_type", "n", "total")


def events_session(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "2 hours").select("user_id", _micros("start").alias("start_us"), "n")


def train_head_regression(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (1.2,))
    return heads.regression_head(node_features(n.nodes, s).join(s.select("circuit_id", "idx", F.col("slack").alias("y"), F.col("depth").cast("double").alias("depth_f")), ["circuit_id", "idx"]))


def train_head_classifier(spark, sf_dir):
    n, s = slacks(spark, sf_dir, (0.95,))
    y = label_table(s, _labels(n)).select("circuit_id", "idx", F.col("critical").alias("y"), F.col("depth").cast("double").alias("depth_f"))
    return heads.classifier_head(node_features(n.nodes, s).join(y, ["circuit_id", "idx"]))


QUERIES = {f.__name__: f for f in (star_join_agg, semi_anti, setops, grouping_sets, window_frames, events_tumbling, events_sliding, events_session, train_head_regression, train_head_classifier)}

ORACLE_SQL = {
    "star_join_agg": "SELECT n_name, c_mktsegment, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment",
    "semi_anti": "SELECT c_mktsegment, count(*) AS n, 'left_semi' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'left_anti' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1",
    "setops": "WITH a AS (SELECT p_partkey AS k FROM part), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 45) SELECT count(*) AS n, sum(k)::BIGINT AS total, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT count(*), sum(k)::BIGINT, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT count(*), sum(k)::BIGINT, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "window_frames": "SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, round(avg(value) OVER (w ROWS 2 PRECEDING), 6) AS trailing, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "events_tumbling": "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 4) AS r(k) GROUP BY 1, 2",
    "events_session": "WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
}
