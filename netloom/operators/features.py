"""Node, edge and label tables of a netlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import library as lib

SCHEMA_VERSION = 9


def _f(column, scale: float, name: str):
    return F.round(F.coalesce(column / scale, F.lit(0.0)), 9).alias(name)


#: The dimensions of a node that only analog circuits fill.
ANALOG = [*(f"is_{d[0].lower()}" for d in lib.DEVICES), "wl_f", "region_f", "symmetry_f"]


def node_features(nodes: DataFrame, slacks: DataFrame) -> DataFrame:
    """All 17 dimensions of the schema; a digital circuit's analog ones are 0."""
    clock = slacks.select("circuit_id", "idx", "clock")
    role = [(F.col("role") == r).cast("double").alias(f"is_{r.lower()}") for r in ("PI", "PO")]
    cell = [_f(F.col("intrinsic_delay"), lib.DELAY_REF, "delay_f"), _f(F.col("input_cap"), lib.CAP_REF, "cap_f"), _f(F.col("output_res"), lib.RES_REF, "res_f"), F.round(F.col("clock") / lib.CLOCK_REF, 13).alias("clock_f")]
    return nodes.join(clock, ["circuit_id", "idx"]).select("circuit_id", "idx", *role, *(F.lit(0.0).alias(x) for x in ANALOG), F.lit(1.0).alias("is_digital"), F.lit(0.0).alias("is_analog"), *cell)


def analog_node_features(devices: DataFrame, clock: float = 0.0) -> DataFrame:
    """The same 17 dimensions of analog nodes (circuit_id, idx, role, device, w, l, region, symmetry).

    Ports have no device. Width over length and the symmetry group (0 for none) are shares of the circuit's greatest.
    """
    ratio, group = F.col("w") / F.greatest("l", F.lit(1e-12)), F.col("symmetry").cast("double")

    def greatest(value, name):
        return F.coalesce(F.max(F.when(value > 0, value)), F.lit(1.0)).alias(name)

    tops = devices.groupBy("circuit_id").agg(greatest(ratio, "top_ratio"), greatest(group, "top_group"))  # no window: a circuit may be large
    devices = devices.join(tops, "circuit_id")
    held = F.col("device").isNotNull()
    role = [F.coalesce(F.col("role") == r, F.lit(False)).cast("double").alias(f"is_{r.lower()}") for r in ("PI", "PO")]
    kind = [F.coalesce(F.col("device") == d[0], F.lit(False)).cast("double").alias(f"is_{d[0].lower()}") for d in lib.DEVICES]
    size = F.when(held, F.round(F.coalesce(ratio, F.lit(0.0)) / F.col("top_ratio"), 9)).otherwise(0.0).alias("wl_f")
    matched = F.when(held, F.round(F.coalesce(group, F.lit(0.0)) / F.col("top_group"), 9)).otherwise(0.0).alias("symmetry_f")
    cell = [F.lit(0.0).alias(x) for x in ("delay_f", "cap_f", "res_f")]
    return devices.select("circuit_id", "idx", *role, *kind, size, F.coalesce("region", F.lit(0.0)).alias("region_f"), matched, F.lit(0.0).alias("is_digital"), F.lit(1.0).alias("is_analog"), *cell, F.lit(clock / lib.CLOCK_REF).alias("clock_f"))


def edge_features(arcs: DataFrame) -> DataFrame:
    return arcs.select("circuit_id", "drv", "snk", _f(F.col("wire_delay"), lib.WIRE_REF, "wire_f"), _f(F.col("manhattan"), lib.MANHATTAN_REF, "manhattan_f"), _f(F.col("fanout"), lib.FANOUT_REF, "fanout_f"), F.lit(0.0).alias("coupling_f"), F.lit(0.0).alias("matching_f"))


def analog_edge_features(devices: DataFrame, wires: DataFrame) -> DataFrame:
    """The same five dimensions of analog edges: coupling by the driver's Cgd, matching within a symmetry group."""
    drv = devices.select("circuit_id", F.col("idx").alias("drv"), "cgd", F.col("symmetry").alias("drv_group"))
    snk = devices.select("circuit_id", F.col("idx").alias("snk"), F.col("input_cap").alias("snk_cap"), F.col("symmetry").alias("snk_group"))
    rows = wires.select("circuit_id", "drv", "snk", "manhattan", "wire_length_um", "fanout").join(drv, ["circuit_id", "drv"]).join(snk, ["circuit_id", "snk"])
    matching = (F.col("drv_group") != 0) & (F.col("drv_group") == F.col("snk_group"))
    wire = lib.wire_delay(F.col("wire_length_um"), F.col("snk_cap") * 1e15)
    return rows.select("circuit_id", "drv", "snk", _f(wire, lib.WIRE_REF, "wire_f"), _f(F.col("manhattan"), lib.MANHATTAN_REF, "manhattan_f"), _f(F.col("fanout"), lib.FANOUT_REF, "fanout_f"), _f(F.col("cgd"), lib.COUPLING_REF, "coupling_f"), F.coalesce(matching, F.lit(False)).cast("double").alias("matching_f"))


def labels(slacks: DataFrame, placed: DataFrame) -> DataFrame:
    timing = slacks.select("circuit_id", "idx", "slack", F.round("at", 13).alias("arrival_time"), F.col("required").alias("required_time"), "depth", F.col("is_critical").cast("double").alias("critical"))
    return timing.join(placed.select("circuit_id", "idx", "congestion", "drc"), ["circuit_id", "idx"])


def augment(arcs: DataFrame, noise: float = 0.05) -> DataFrame:
    """Edges with noise in proportion to the circuit's spread, a twentieth of them dropped; both by an integer hash."""
    wire = F.col("wire_delay") / lib.WIRE_REF
    spreads = arcs.groupBy("circuit_id").agg(F.stddev_pop(wire).alias("spread"))
    arcs, spread = arcs.join(spreads, "circuit_id"), F.col("spread")
    swing = ((F.col("drv") * 7919 + F.col("snk") * 104729) % 2001) / 1000.0 - 1.0
    noisy = arcs.select("circuit_id", "drv", "snk", F.round(wire + noise * spread * swing, 9).alias("wire_f"))
    return noisy.where("(drv * 31 + snk * 17 + circuit_id) % 20 <> 0")
