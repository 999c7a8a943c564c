"""Analog small-signal pass: transconductance, gain-bandwidth score and parasitic impact from one-hop sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import library as lib

#: Ports and (device, terminal nets) of each topology; the last net is the output.
TEMPLATES = {
    "current_mirror": ["NMOS", "NMOS", "CURRENT_MIRROR"],
    "common_source_amp": ["NMOS", "R", "C"],
    "diff_pair": ["NMOS", "NMOS", "PMOS", "PMOS", "CURRENT_MIRROR", "DIFF_PAIR"],
    "two_stage_opamp": ["NMOS", "NMOS", "PMOS", "PMOS", "NMOS", "PMOS", "NMOS", "C", "R"],
    "folded_cascode": ["PMOS", "PMOS", "NMOS", "NMOS", "NMOS", "NMOS", "PMOS", "PMOS", "CURRENT_MIRROR"],
}


def generate(spark, topologies, seeds: DataFrame, jitter: float = 0.2) -> DataFrame:
    """Devices of each topology for each seed (one column, seed): width jittered by a hash within +/- `jitter`."""
    unknown = [t for t in topologies if t not in TEMPLATES]
    if unknown:
        raise ValueError(f"unknown topology: {', '.join(unknown)}")
    rows = [(t, i, d) for t in topologies for i, d in enumerate(TEMPLATES[t])]
    template = spark.createDataFrame(rows, "topology string, idx long, device string")
    devices = lib.devices(spark).select("device", "w", "l", "cgs", "cgd", "gm", F.col("input_cap"))
    swing = (F.pmod(F.xxhash64("seed", "topology", "idx"), F.lit(20001)) / 10000.0 - 1.0) * jitter
    return seeds.join(F.broadcast(template)).join(F.broadcast(devices), "device").withColumn("w", F.col("w") * (1.0 + swing))


def for_requests(specs: DataFrame) -> DataFrame:
    """specs with a row for each device (idx, device, w, l) of its topology; the first template where it is unknown or null."""
    spark = specs.sparkSession
    rows = [(t, i, d) for t, devices in TEMPLATES.items() for i, d in enumerate(devices)]
    template = spark.createDataFrame(rows, "topology string, idx long, device string")
    known = F.when(F.col("topology").isin(*TEMPLATES), F.col("topology")).otherwise(next(iter(TEMPLATES)))
    sizes = lib.devices(spark).select("device", "w", "l")
    return specs.withColumn("topology", known).join(F.broadcast(template), "topology").join(F.broadcast(sizes), "device")


def small_signal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: device, gm, gain, GBW (log10 Hz), score, parasitic impact and whether bandwidth limits it."""
    dev = F.broadcast(lib.devices(nodes.sparkSession))
    bias = F.lit(lib.BIAS_A)
    d = nodes.select("circuit_id", "idx", (F.col("event_id") % 6).alias("dev_idx")).join(dev, "dev_idx")
    gain = F.lit(0.0)
    for name, mobility, lam in (("NMOS", lib.MU_N, lib.LAMBDA_N), ("PMOS", lib.MU_P, lib.LAMBDA_P)):
        gain = F.when(F.col("device") == name, lib.estimate_gm(F.lit(mobility), F.col("w"), F.col("l"), bias) / (lam * bias)).otherwise(gain)
    d = d.select("circuit_id", "idx", "device", "cgd", F.coalesce("gm", F.lit(0.0)).alias("gm"), lib.device_cap().alias("own"), gain.alias("gain"))
    sink = d.select("circuit_id", F.col("idx").alias("snk"), F.col("own").alias("sink_cap"), F.coalesce("cgd", F.lit(0.0)).alias("sink_cgd"))
    around = edges.join(sink, ["circuit_id", "snk"]).groupBy("circuit_id", F.col("drv").alias("idx")).agg(F.sum("sink_cap").alias("caps"), F.sum("sink_cgd").alias("coupling"))
    s = d.join(around, ["circuit_id", "idx"], "left")
    load = F.col("own") + F.coalesce("caps", F.lit(0.0)) + 1e-18
    s = s.withColumn("gbw", F.when(F.col("gm") > 0, F.log10(F.greatest(F.col("gm") / load / (2.0 * math.pi), F.lit(1.0)))).otherwise(F.lit(0.0)))
    s = s.withColumn("par", F.coalesce("coupling", F.lit(0.0)) + F.col("own"))
    tops = s.groupBy("circuit_id").agg(F.greatest(F.max("gbw"), F.lit(1.0)).alias("top_gbw"), F.greatest(F.max("par"), F.lit(1e-18)).alias("top_par"))
    s = s.join(tops, "circuit_id")
    score, impact = F.col("gbw") / F.col("top_gbw"), F.col("par") / F.col("top_par")
    return s.select("circuit_id", "idx", "device", "gm", F.round("gain", 9).alias("intrinsic_gain"), F.round("gbw", 9).alias("gbw_log10_hz"), F.round(score, 9).alias("gbw_score"), F.round(impact, 9).alias("parasitic_impact"), ((F.col("gm") > 0) & (impact > 0.5) & (score < 0.5)).alias("bandwidth_limited"))
