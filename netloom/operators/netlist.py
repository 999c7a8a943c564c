"""Netlist tables: nodes, edges, nets, delays. Circuits are the unit of partitioning; every table carries circuit_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import library as lib


def nodes_from_events(events: DataFrame) -> DataFrame:
    """The netlist that the events of each user stand for: one node for each event, in time order, with role and place."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = events.select(F.col("user_id").alias("circuit_id"), "event_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.count("*").over(Window.partitionBy("user_id")).alias("n")).where("n >= 12")
    role = F.when(F.col("idx") < 4, "PI").when(F.col("idx") >= F.col("n") - 3, "PO").otherwise("GATE")
    base = base.withColumn("role", role).withColumn("cell_idx", F.when(F.col("role") == "GATE", F.col("event_id") % 19))
    cells = F.broadcast(lib.cells(events.sparkSession))
    nodes = base.join(cells, "cell_idx", "left")
    side = F.greatest(F.lit(6), F.floor(F.sqrt(F.col("n").cast("double")) * 1.6)).cast("long")
    nodes = nodes.withColumn("side", side)
    slot = (F.col("event_id") * 7919) % ((F.col("side") - 2) * F.col("side"))
    x = F.when(F.col("role") == "PI", F.lit(0)).when(F.col("role") == "PO", F.col("side") - 1).otherwise(1 + F.floor(slot / F.col("side")))
    y = F.when(F.col("role") == "PI", F.floor(F.col("idx") * F.col("side") / 4)).when(F.col("role") == "PO", F.floor((F.col("idx") - F.col("n") + 3) * F.col("side") / 3)).otherwise(slot % F.col("side"))
    return nodes.select("circuit_id", "idx", "event_id", "n", "role", F.coalesce("cell", "role").alias("node_type"), "side", x.cast("long").alias("x"), y.cast("long").alias("y"), "cell_idx", "intrinsic_delay", "input_cap", "output_res", "num_inputs")


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes (circuit_id, idx, role, node_type) of any netlist with places and cell parameters: inputs in the first column,
    outputs in the last, gates inside by a hash of their index. Indices number the inputs first and the outputs last."""
    of = Window.partitionBy("circuit_id")
    count = lambda role: F.sum((F.col("role") == role).cast("long")).over(of)
    rows = nodes.withColumns({"n": F.count("*").over(of), "n_in": count("PI"), "n_out": count("PO")})
    rows = rows.withColumn("side", F.greatest(F.lit(6), F.floor(F.sqrt(F.col("n").cast("double")) * 1.6)).cast("long"))
    slot = (F.col("idx") * 7919) % ((F.col("side") - 2) * F.col("side"))
    x = F.when(F.col("role") == "PI", F.lit(0)).when(F.col("role") == "PO", F.col("side") - 1).otherwise(1 + F.floor(slot / F.col("side")))
    y = F.when(F.col("role") == "PI", F.floor(F.col("idx") * F.col("side") / F.col("n_in"))).when(F.col("role") == "PO", F.floor((F.col("idx") - F.col("n") + F.col("n_out")) * F.col("side") / F.col("n_out"))).otherwise(slot % F.col("side"))
    cells = F.broadcast(lib.cells(nodes.sparkSession)).drop("cell_idx", "drive_strength", "function")  # a row for each library cell
    rows = rows.withColumns({"x": x.cast("long"), "y": y.cast("long")}).join(cells.withColumnRenamed("cell", "node_type"), "node_type", "left")
    return rows.select("circuit_id", "idx", "n", "role", "node_type", "side", "x", "y", "intrinsic_delay", "input_cap", "output_res", "num_inputs")


def _drivers() -> Column:
    """The distinct drivers of a node: a gate has one for each pin, an output one."""
    reach = F.greatest(F.lit(1), F.least("idx", F.lit(8)))
    pins = F.transform(F.sequence(F.lit(0).cast("long"), F.col("num_inputs") - 1), lambda p: F.col("idx") - 1 - (F.col("event_id") * 7 + 3 * p) % reach)
    return F.when(F.col("role") == "GATE", F.array_distinct(pins)).when(F.col("role") == "PO", F.array(F.col("n") - 4 - F.col("event_id") % 4))


def edges_of(nodes: DataFrame) -> DataFrame:
    """Distinct (driver, sink) pairs; each node has its own drivers, so no shuffle is needed to tell them apart."""
    return nodes.select("circuit_id", F.explode(_drivers()).alias("drv"), F.col("idx").alias("snk"))


def _dealt(rows: DataFrame, tasks: int | None, end: str) -> DataFrame:
    return rows.repartition(tasks, "circuit_id", end) if tasks else rows


def pins_of(nodes: DataFrame, edges: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Edges with the places of both ends and the sink's pin capacitance. The drivers are joined last, so that nets need no
    shuffle of their own; without edges, each node's own drivers are taken and no sink is joined. The joins are dealt over
    so many tasks, else over as many as Spark takes."""
    cap = F.when(F.col("role") == "PO", F.lit(lib.PO_CAP)).otherwise(F.coalesce("input_cap", F.lit(lib.PO_CAP)))
    sink = ["circuit_id", F.col("idx").alias("snk"), F.col("x").alias("sx"), F.col("y").alias("sy"), cap.alias("pin_cap")]
    if edges is None:
        sinks = nodes.select(*sink, F.explode(_drivers()).alias("drv"))
    else:
        sinks = _dealt(edges, tasks, "snk").join(_dealt(nodes.select(*sink), tasks, "snk"), ["circuit_id", "snk"])
    driver = nodes.select("circuit_id", F.col("idx").alias("drv"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return _dealt(sinks, tasks, "drv").join(_dealt(driver, tasks, "drv"), ["circuit_id", "drv"])


def nets_of(pins: DataFrame) -> DataFrame:
    """One net for each driver: length from the farthest sink, fan-out, pin capacitance, bounding box."""
    far = F.abs(F.col("dx") - F.col("sx")) + F.abs(F.col("dy") - F.col("sy"))
    return pins.groupBy("circuit_id", "drv").agg(
        (2.0 + 2.0 * F.max(far)).alias("wire_length_um"), F.count("*").alias("fanout"), F.sum("pin_cap").alias("pin_cap_sum"),
        F.least(F.min("dx"), F.min("sx")).alias("x0"), F.greatest(F.max("dx"), F.max("sx")).alias("x1"), F.least(F.min("dy"), F.min("sy")).alias("y0"), F.greatest(F.max("dy"), F.max("sy")).alias("y1"),
    )


def loads_of(nodes: DataFrame, nets: DataFrame) -> DataFrame:
    """Load capacitance and own gate delay of each node."""
    loaded = nodes.join(nets.select("circuit_id", F.col("drv").alias("idx"), "wire_length_um", "pin_cap_sum"), ["circuit_id", "idx"], "left")
    length = F.coalesce("wire_length_um", F.when(F.col("role") == "PO", F.lit(0.0)).otherwise(F.lit(lib.UNLOADED_UM)))
    load = (F.coalesce("pin_cap_sum", F.lit(0.0)) + lib.WIRE_CAP * length).alias("load_cap")
    loaded = loaded.select("circuit_id", "idx", "role", "node_type", "intrinsic_delay", "output_res", load)
    delay = F.when(F.col("role") == "GATE", lib.gate_delay(F.col("intrinsic_delay"), F.col("output_res"), F.col("load_cap"))).otherwise(F.lit(0.0))
    return loaded.select("circuit_id", "idx", "role", "node_type", "load_cap", delay.alias("gate_delay"))


def wires_of(pins: DataFrame) -> DataFrame:
    """Pins with the delay of their wire, the length and fan-out of its net and the distance of its ends. Nodes' own delays
    are not in it, so it costs one join of the drivers."""
    net = Window.partitionBy("circuit_id", "drv")  # the sinks of one net, as the join has brought them together
    manhattan = F.abs(F.col("dx") - F.col("sx")) + F.abs(F.col("dy") - F.col("sy"))
    wires = pins.select("circuit_id", "drv", "snk", "pin_cap", manhattan.alias("manhattan"))
    wires = wires.withColumns({"wire_length_um": 2.0 + 2.0 * F.max("manhattan").over(net), "fanout": F.count("*").over(net)})
    return wires.withColumn("wire_delay", lib.wire_delay(F.col("wire_length_um"), F.col("pin_cap")))


def arcs_of(wires: DataFrame, loads: DataFrame) -> DataFrame:
    """Timing arcs: forward delay has the driver's gate delay, backward delay the sink's; both have the wire's."""
    driver, sink = (loads.select("circuit_id", F.col("idx").alias(k), F.col("gate_delay").alias(f"{k}_delay")) for k in ("drv", "snk"))
    arcs = wires.join(sink, ["circuit_id", "snk"]).join(driver, ["circuit_id", "drv"])
    return arcs.select("circuit_id", "drv", "snk", "wire_delay", (F.col("drv_delay") + F.col("wire_delay")).alias("fwd"), (F.col("snk_delay") + F.col("wire_delay")).alias("bwd"), "manhattan", "fanout", "pin_cap")


class Netlist:
    """The tables of one netlist, each built from the ones before."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | None = None, tasks: int | None = None):
        self.nodes = nodes
        self.edges = edges_of(nodes) if edges is None else edges
        self.pins = pins_of(nodes, edges, tasks)
        self.nets = nets_of(self.pins)
        self.loads = loads_of(self.nodes, self.nets)
        self.wires = wires_of(self.pins)
        self.arcs = arcs_of(self.wires, self.loads)
