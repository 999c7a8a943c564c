"""Routing demand over the placement grid, node congestion and design-rule hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.library import DRC_DEMAND


def demand_grid(nets: DataFrame) -> DataFrame:
    """(circuit_id, gx, gy, demand): each net spreads half-perimeter x fan-out over the cells of its bounding box."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = nets.where((w + h) > 0).withColumn("per_cell", (w + h) * F.greatest("fanout", F.lit(1)) / ((w + 1) * (h + 1)))
    cells = boxes.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1")))
    return cells.groupBy("circuit_id", "gx", "gy").agg(F.round(F.sum("per_cell"), 9).alias("demand"))


def node_labels(nodes: DataFrame, grid: DataFrame) -> DataFrame:
    """Demand, congestion (demand over the greatest of the circuit's nodes) and hotspot flag of each node."""
    placed = nodes.select("circuit_id", "idx", F.col("x").alias("gx"), F.col("y").alias("gy")).join(grid, ["circuit_id", "gx", "gy"], "left")
    placed = placed.withColumn("demand", F.coalesce("demand", F.lit(0.0)))
    tops = placed.groupBy("circuit_id").agg(F.greatest(F.max("demand"), F.lit(1e-6)).alias("top"))  # no window: a circuit may be large
    top, placed = F.col("top"), placed.join(tops, "circuit_id")
    return placed.select("circuit_id", "idx", "demand", F.round(F.col("demand") / top, 9).alias("congestion"), (F.col("demand") > DRC_DEMAND).cast("double").alias("drc"))
