"""Streams with state, mergeable sketches and table functions, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import mapping, sketches
from ..sources.tables import checkpointed, new_folder, table
from ..streaming import summaries
from .advice_queries import ORACLE_SQL as ADVICE_SQL, part_gates

NODES = 50


def reports_of(events: DataFrame) -> DataFrame:
    """Each event as a report of a node's slack."""
    return events.select(F.col("user_id").alias("circuit_id"), (F.col("event_id") % NODES).alias("node"), "ts", F.col("event_id").alias("report_id"), ((F.col("value") - 50.0) / 100.0).alias("slack"))


def slack_summaries(spark, sf_dir) -> DataFrame:
    """Latest reports of each circuit, over the whole table."""
    return summaries.batch_summaries(reports_of(table(spark, sf_dir, "events"))).withColumn("worst_slack", F.round("worst_slack", 9))


def stream_summaries(spark, sf_dir):
    """The same, kept by a stream over the table's files."""
    schema, path = table(spark, sf_dir, "events").schema, new_folder(spark)
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    summaries.keep(summaries.stream_summaries(reports_of(events)), path, new_folder(spark)).awaitTermination()
    return summaries.latest(spark, path).drop("idle").withColumn("worst_slack", F.round("worst_slack", 9))


def sketch_rollup(spark, sf_dir):
    """Sketches of each supplier's lines, stored, rolled up by remainder, and whether they keep their error bounds."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("long").alias("part"), "l_suppkey", "l_orderkey", "l_extendedprice")
    stored = checkpointed(sketches.sketches(lines, ["part", "l_suppkey"], "l_orderkey", "l_extendedprice"))
    found = checkpointed(sketches.estimates(sketches.rolled_up(stored, ["part"]), ["part"], (0.25, 0.5, 0.9)))
    exact = lines.groupBy("part").agg(F.countDistinct("l_orderkey").alias("true_distinct"))
    near = lines.join(F.broadcast(found.select("part", "q25", "q50", "q90")), "part")  # four rows
    ranks = near.groupBy("part").agg(*(F.avg((F.col("l_extendedprice") <= F.col(q)).cast("double")).alias(f"r_{q}") for q in ("q25", "q50", "q90")))
    ok = [F.abs(F.col(f"r_q{s}") - s / 100) < 0.04 for s in (25, 50, 90)]
    both = found.join(exact, "part").join(ranks, "part")
    return both.select("part", "n", "true_distinct", (F.abs(F.col("distinct") / F.col("true_distinct") - 1) < 0.06).alias("distinct_near"), (ok[0] & ok[1] & ok[2]).alias("quantiles_near"))


def gate_trees(spark, sf_dir):
    """gate_decompose by the table function."""
    cells = mapping.gate_trees(part_gates(spark, sf_dir))
    return cells.groupBy("gate").agg(F.count("*").alias("cells"), F.sum(F.size("ins")).cast("long").alias("pins"), F.sum((F.col("cell") == "INV_X1").cast("long")).alias("inverters"))


QUERIES = {f.__name__: f for f in (slack_summaries, stream_summaries, sketch_rollup, gate_trees)}

_SUMMARY = f"WITH last AS (SELECT user_id AS circuit_id, event_id % {NODES} AS node, arg_max((value - 50e0) / 100e0, (ts, event_id)) AS slack FROM events GROUP BY ALL) SELECT circuit_id, count(*) AS n, count(*) FILTER (slack <= 0) AS n_violations, round(min(slack), 9) AS worst_slack, arg_min(node, (slack, node)) AS worst_node FROM last GROUP BY circuit_id"
ORACLE_SQL = {
    "slack_summaries": _SUMMARY,
    "stream_summaries": _SUMMARY,
    "sketch_rollup": "SELECT (l_suppkey % 4)::BIGINT AS part, count(*) AS n, count(DISTINCT l_orderkey) AS true_distinct, true AS distinct_near, true AS quantiles_near FROM lineitem GROUP BY 1",
    "gate_trees": ADVICE_SQL["gate_decompose"],
}
