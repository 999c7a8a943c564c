"""Cones cut out of circuits as circuits of their own, and predictions judged by the circuit they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import checkpointed
from . import timing
from .numbering import numbered


def cone_circuits(nodes: DataFrame, edges: DataFrame, per_circuit: int | None = None, least: int = 8, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the fan-in cones of all outputs, or of up to `per_circuit` of each circuit, as circuits.

    nodes has circuit_id, idx, role, node_type. A node may be in many cones. A cone's circuit_id is its dense number over
    all circuits and seeds; parent and seed say where it was cut out, parent_idx which node a node was. Inside a cone the
    inputs come first, then the gates in their order, then the seed, the only output; another output inside is a gate. Cones
    without an input or of fewer than `least` nodes are left out.
    """
    seeds = nodes.where("role = 'PO'").select("circuit_id", "idx")
    member = checkpointed(timing.fanin_cones(edges, seeds, most))
    typed = member.join(nodes.select("circuit_id", "idx", "role", "node_type"), ["circuit_id", "idx"])
    sizes = typed.groupBy("circuit_id", "seed").agg(F.count("*").alias("n"), F.sum((F.col("role") == "PI").cast("int")).alias("inputs")).where((F.col("n") >= least) & (F.col("inputs") > 0))
    kept = sizes.select("circuit_id", "seed")
    if per_circuit is not None:
        order = Window.partitionBy("circuit_id").orderBy(F.expr("(seed * 7919) % 1009"), "seed")  # a row for each output
        kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_circuit).select("circuit_id", "seed")
    kept = numbered(kept, ["circuit_id", "seed"], "cone")
    role = F.when(F.col("idx") == F.col("seed"), "PO").when(F.col("role") == "PI", "PI").otherwise("GATE")
    rows = typed.join(kept, ["circuit_id", "seed"]).withColumns({"role": role, "node_type": F.when(F.col("idx") == F.col("seed"), "PO").otherwise(F.col("node_type"))})
    place = Window.partitionBy("cone").orderBy(F.when(F.col("role") == "PI", 0).when(F.col("role") == "GATE", 1).otherwise(2), "idx")  # the nodes of one cone
    rows = checkpointed(rows.select(F.col("cone").alias("circuit_id"), (F.row_number().over(place) - 1).cast("long").alias("idx"), "role", "node_type", F.col("circuit_id").alias("parent"), "seed", F.col("idx").alias("parent_idx")))
    own = lambda end: rows.select("circuit_id", "parent", F.col("parent_idx").alias(f"p_{end}"), F.col("idx").alias(end))
    inner = edges.select(F.col("circuit_id").alias("parent"), F.col("drv").alias("p_drv"), F.col("snk").alias("p_snk"))
    inner = inner.join(own("drv"), ["parent", "p_drv"]).join(own("snk"), ["circuit_id", "parent", "p_snk"])
    return rows, inner.select("circuit_id", "drv", "snk")


def _auc_by(scored: DataFrame, key: str) -> DataFrame:
    """(key, auc): tie-averaged rank statistic for each value of key, over its distinct scores."""
    each = scored.groupBy(key, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    below = Window.partitionBy(key).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # the scores of one named circuit
    ranked = each.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    sums = ranked.groupBy(key).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2.0)).alias("area"), F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    return sums.select(key, F.when((F.col("ps") > 0) & (F.col("ns") > 0), F.round(F.col("area") / (F.col("ps") * F.col("ns")), 9)).alias("auc"))


def named_metrics(rows: DataFrame, key: str, numbers: dict[str, tuple[str, str]], flags: dict[str, tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """(key, task, n, r2, mae, auc, f1) by the circuit that `key` names, pooled over all its rows.

    numbers and flags name, for each task, the columns of prediction and target; a flag's score counts as 1 from `threshold`.
    A figure that is not defined (no spread, one class) is null.
    """
    nothing, out = F.lit(None).cast("double"), None
    for task, (pred, target) in numbers.items():
        p, t = F.col(pred), F.col(target)
        spread = F.sum(t * t) - F.sum(t) * F.sum(t) / F.count("*")
        found = rows.groupBy(key).agg(F.count("*").alias("n"), F.when(F.round(spread, 9) > 0, F.round(1.0 - F.sum((p - t) * (p - t)) / spread, 6)).alias("r2"), F.round(F.avg(F.abs(p - t)), 6).alias("mae"))
        one = found.select(key, F.lit(task).alias("task"), "n", "r2", "mae", nothing.alias("auc"), nothing.alias("f1"))
        out = one if out is None else out.unionByName(one)
    for task, (score, target) in flags.items():
        y, hit = F.col(target).cast("long"), F.col(score) >= threshold
        cell = lambda x: F.sum(x.cast("long"))
        found = rows.groupBy(key).agg(F.count("*").alias("n"), cell(hit & (y == 1)).alias("tp"), cell(hit & (y == 0)).alias("fp"), cell(~hit & (y == 1)).alias("fn"))
        f1: Column = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))
        area = _auc_by(rows.select(key, F.col(score).alias("score"), y.alias("y")), key)
        one = found.join(area, key).select(key, F.lit(task).alias("task"), "n", nothing.alias("r2"), nothing.alias("mae"), "auc", f1.alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out
