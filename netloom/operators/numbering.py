"""Dense numbers and running sums over a whole table, without a window over all rows.

Rows are ranged by the order; each range is summed by itself, the sums of the ranges before it are added (a row for each
range), and a window inside each range does the rest. So no task sees all rows, and the order may be any columns that
together are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import checkpointed


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name: column in `sums`, the sum of the column over all rows before; "1" counts rows."""
    value = {name: F.lit(1).cast("long") if c == "1" else F.col(c).cast("long") for name, c in sums.items()}
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__{name}") for name, v in value.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("__part", *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums))
    here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), "__part")
    return out.withColumns({name: F.col(f"__{name}") + F.coalesce(F.sum(v).over(here), F.lit(0)) for name, v in value.items()}).drop("__part", *(f"__{name}" for name in sums))


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with 0, 1, 2, ... in the order of these columns."""
    return running(rows, order, {name: "1"})


def mixed_dataset(parts: dict[str, DataFrame]) -> DataFrame:
    """(graph, kind, circuit_id, nodes, first_node) of several tables (circuit_id, nodes), one after another: graph numbers
    all circuits densely, first_node is the number of the circuit's first node among those of all circuits."""
    every = None
    for at, (kind, rows) in enumerate(parts.items()):
        one = rows.select(F.lit(at).alias("at"), F.lit(kind).alias("kind"), "circuit_id", "nodes")
        every = one if every is None else every.unionByName(one)
    return running(every, ["at", "circuit_id"], {"graph": "1", "first_node": "nodes"}).select("graph", "kind", "circuit_id", "nodes", "first_node")
