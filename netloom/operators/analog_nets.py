"""Analog circuits with nets: devices, ports and an incidence table of nets, expanded to device edges where needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import library as lib

# For each topology its ports (name, role, place), devices (name, kind, place, width in um or nothing, length in nm
# or nothing, symmetry group) and nets (driver > sinks). Devices of a symmetry group have one width.
TOPOLOGIES = {
    "current_mirror": """
        port IREF PI 0 0
        port IOUT PO 3 0
        device M1 NMOS 1 0 5 130 1
        device M2 NMOS 2 0 5 130 1
        net IREF > M1
        net M1 > M2
        net M2 > IOUT""",
    "common_source_amp": """
        port VIN PI 0 1
        port VOUT PO 3 1
        device M1 NMOS 1 1 4 130 0
        device R1 R 2 1 - - 0
        net VIN > M1
        net M1 > R1
        net R1 > VOUT""",
    "diff_pair": """
        port VINP PI 0 0
        port VINM PI 0 2
        port VOUTP PO 4 0
        port VOUTM PO 4 2
        port VBIAS PI 0 1
        device M1 NMOS 2 0 4 130 1
        device M2 NMOS 2 2 4 130 1
        device MTAIL NMOS 2 1 8 200 0
        device R1 R 3 0 - - 2
        device R2 R 3 2 - - 2
        net VINP > M1
        net VINM > M2
        net VBIAS > MTAIL
        net MTAIL > M1 M2
        net M1 > R1
        net M2 > R2
        net R1 > VOUTP
        net R2 > VOUTM""",
    "two_stage_opamp": """
        port VINP PI 0 0
        port VINM PI 0 4
        port VBIAS PI 0 2
        port VOUT PO 6 2
        device M1 NMOS 2 1 4 130 1
        device M2 NMOS 2 3 4 130 1
        device M3 PMOS 3 1 6 200 2
        device M4 PMOS 3 3 6 200 2
        device M5 NMOS 2 2 10 200 0
        device M6 NMOS 4 3 8 130 0
        device M7 PMOS 4 1 16 200 0
        device Cc C 5 2 - - 0
        net VINP > M1
        net VINM > M2
        net VBIAS > M5
        net M5 > M1 M2
        net M1 > M3
        net M2 > M4 M6
        net M3 > M4
        net M6 > M7 Cc
        net M7 > VOUT
        net Cc > VOUT""",
    "folded_cascode": """
        port VINP PI 0 1
        port VINM PI 0 3
        port VBIAS PI 0 2
        port VOUT PO 5 2
        device M1 NMOS 2 1 4 130 1
        device M2 NMOS 2 3 4 130 1
        device M3 PMOS 3 1 6 200 2
        device M4 PMOS 3 3 6 200 2
        device M5 NMOS 4 1 6 200 3
        device M6 NMOS 4 3 6 200 3
        device MTAIL NMOS 2 2 10 200 0
        net VINP > M1
        net VINM > M2
        net VBIAS > MTAIL
        net MTAIL > M1 M2
        net M1 > M3
        net M2 > M4
        net M3 > M5
        net M4 > M6 VOUT
        net M5 > M6""",
}
#: Fixed value: length of every analog net in um.
NET_UM = 5.0


def _statements() -> list[tuple]:
    return [(t, k, *line.split()) for t, text in TOPOLOGIES.items() for k, line in enumerate(text.strip().split("\n"))]


def node_rows() -> list[tuple]:
    """(topology, idx, name, role, kind, x, y, width, length, symmetry): ports and devices in the order of the text."""
    out, at = [], {}
    for t, _, what, *rest in _statements():
        if what == "net":
            continue
        idx = at[t] = at.get(t, -1) + 1
        if what == "port":
            name, role, x, y = rest
            out.append((t, idx, name, role, None, int(x), int(y), None, None, 0))
        else:
            name, kind, x, y, w, length, group = rest
            out.append((t, idx, name, "GATE", kind, int(x), int(y), None if w == "-" else float(w) * 1e-6, None if length == "-" else float(length) * 1e-9, int(group)))
    return out


def pin_rows() -> list[tuple]:
    """(topology, net, idx, is_driver, place): the ends of each net, its driver first."""
    names = {(r[0], r[2]): r[1] for r in node_rows()}
    out, at = [], {}
    for t, _, what, *rest in _statements():
        if what == "net":
            net = at[t] = at.get(t, -1) + 1
            out += [(t, net, names[t, name], k == 0, k) for k, name in enumerate([rest[0], *rest[2:]])]
    return out


def swing(seed: Column, key: Column, part: float = 0.2) -> Column:
    """1 plus a share between -part and part, by an integer hash of the seed and the key."""
    return 1.0 + ((seed * 7919 + key * 104_729) % 2001 / 1000.0 - 1.0) * part


def analog_circuits(seeds: DataFrame, topology: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, pins) of a circuit for each seed >= 0 of `seeds` (seed): of the topology, or of the one that the seed picks.

    nodes: circuit_id (the seed), topology, idx, name, role, device, x, y, w, l, symmetry and the device's other parameters;
    pins: circuit_id, net, idx, is_driver, place. Widths vary by up to a fifth, alike for the devices of a symmetry group.
    """
    if topology is not None and topology not in TOPOLOGIES:
        raise ValueError(f"unknown topology: {topology}")
    spark, names = seeds.sparkSession, list(TOPOLOGIES)
    picked = F.lit(topology) if topology else F.element_at(F.array(*map(F.lit, names)), (F.col("seed") % len(names) + 1).cast("int"))
    own = seeds.select(F.col("seed").cast("long").alias("circuit_id"), picked.alias("topology"))
    nodes = spark.createDataFrame(node_rows(), "topology string, idx long, name string, role string, device string, x long, y long, w double, l double, symmetry long")
    pins = spark.createDataFrame(pin_rows(), "topology string, net long, idx long, is_driver boolean, place long")
    kinds = lib.devices(spark).drop("dev_idx", "w", "l")
    rows = own.join(F.broadcast(nodes), "topology").join(F.broadcast(kinds), "device", "left")  # some dozens of rows
    key = F.when(F.col("symmetry") > 0, F.col("symmetry")).otherwise(10 + F.col("idx"))
    return rows.withColumn("w", F.col("w") * swing(F.col("circuit_id"), key)), own.join(F.broadcast(pins), "topology").drop("topology")


def net_edges(pins: DataFrame, keep_repeated: bool = True) -> DataFrame:
    """(circuit_id, net, drv, snk, fanout): each net's driver with each of its sinks; two nets between the same ends are two
    edges, unless only distinct ones are wanted."""
    driver = pins.where("is_driver").select("circuit_id", "net", F.col("idx").alias("drv"))
    sinks = pins.where("NOT is_driver").select("circuit_id", "net", F.col("idx").alias("snk"))
    fans = sinks.groupBy("circuit_id", "net").agg(F.count("*").alias("fanout"))
    edges = driver.join(fans, ["circuit_id", "net"]).join(sinks, ["circuit_id", "net"])
    if keep_repeated:
        return edges.select("circuit_id", "net", "drv", "snk", "fanout")
    return edges.groupBy("circuit_id", "drv", "snk").agg(F.min("net").alias("net"), F.max("fanout").alias("fanout")).select("circuit_id", "net", "drv", "snk", "fanout")


def analog_edges(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """(circuit_id, net, drv, snk, wire_f, manhattan_f, fanout_f, coupling_f, matching_f): the edge features of the schema.

    Coupling is the driver's gate-drain capacitance, matching whether both ends are in one symmetry group.
    """
    end = lambda name, *more: nodes.select("circuit_id", F.col("idx").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"), F.col("symmetry").alias(f"{name}_group"), *more)
    rows = net_edges(pins).join(end("drv", "cgd"), ["circuit_id", "drv"]).join(end("snk", F.coalesce("input_cap", F.lit(2e-15)).alias("cap")), ["circuit_id", "snk"])
    far = F.abs(F.col("drv_x") - F.col("snk_x")) + F.abs(F.col("drv_y") - F.col("snk_y"))
    same = (F.col("drv_group") > 0) & (F.col("drv_group") == F.col("snk_group"))
    values = {"wire_f": lib.wire_delay(F.lit(NET_UM), F.col("cap") * 1e15) / lib.WIRE_REF, "manhattan_f": far / lib.MANHATTAN_REF, "fanout_f": F.col("fanout") / lib.FANOUT_REF, "coupling_f": F.coalesce(F.col("cgd") / lib.COUPLING_REF, F.lit(0.0)), "matching_f": same.cast("double")}
    return rows.select("circuit_id", "net", "drv", "snk", *(F.round(v, 9).alias(k) for k, v in values.items()))
