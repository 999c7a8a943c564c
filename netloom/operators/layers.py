"""Layers with given weights over the node vectors of many circuits: timing backbone, graph convolution, edge-aware sums.

Weights are lists of rows, fitted elsewhere; every layer is joins along edges and grouping by node or circuit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .messages import relax_sweeps

Matrix = list[list[float]]


def _row(weights: list[float], vector: str) -> Column:
    return sum((w * F.col(vector)[j] for j, w in enumerate(weights[1:], 1)), weights[0] * F.col(vector)[0])


def linear(weights: Matrix, vector: str) -> Column:
    """The array of the rows of `weights` times the array `vector`."""
    return F.array(*(_row(w, vector) for w in weights))


def _pooled(vectors: DataFrame, size: int, reduce, name: str) -> DataFrame:
    return vectors.groupBy("circuit_id").agg(F.array(*(F.round(reduce(F.col("v")[k]), 9) for k in range(size))).alias(name))


def _plus(a: str, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def timing_backbone(vectors: DataFrame, arcs: DataFrame, term: Callable[[int], Column], seed: Matrix, raw: Matrix, context: Matrix, sweeps: int, size: int) -> DataFrame:
    """(circuit_id, idx, v): arrival half, required half, plus the raw vector and the circuit's mean through weights.

    The arrival half is `sweeps` rounds of max messages along the edges. Its maximum over the circuit, through `seed`, is
    added to the vectors from which the required half starts: as many rounds of min messages against the edges.
    """
    forward = relax_sweeps(vectors, arcs, sweeps, size, "max", 1.0, term)
    start = vectors.join(_pooled(forward, size, F.max, "top"), "circuit_id").select("circuit_id", "idx", _plus("v", linear(seed, "top")).alias("v"))
    turned = {"drv": "snk", "snk": "drv"}
    back = arcs.select(*(F.col(c).alias(turned.get(c, c)) for c in arcs.columns))
    backward = relax_sweeps(start, back, sweeps, size, "min", -1.0, term)
    own = vectors.join(_pooled(vectors, size, F.avg, "c"), "circuit_id").withColumnRenamed("v", "x")  # first, while the rows are short
    both = own.join(forward.withColumnRenamed("v", "f"), ["circuit_id", "idx"]).join(backward.withColumnRenamed("v", "b"), ["circuit_id", "idx"])
    return both.withColumn("v", F.concat("f", "b")).select("circuit_id", "idx", F.zip_with(_plus("v", linear(raw, "x")), linear(context, "c"), lambda x, y: x + y).alias("v"))


def graph_convolution(vectors: DataFrame, edges: DataFrame, weights: Matrix, size: int, epsilon: float = 1e-5) -> DataFrame:
    """(circuit_id, idx, v): sums over drivers and the node itself, each divided by the root of both degrees, through
    `weights`; normalised over all nodes, rectified exponentially (ELU) and added to the node's own vector.

    A node's degree is its number of drivers and one for itself.
    """
    degree = edges.groupBy("circuit_id", F.col("snk").alias("idx")).agg(F.count("*").alias("drivers"))
    own = vectors.join(degree, ["circuit_id", "idx"], "left").select("circuit_id", "idx", "v", linear(weights, "v").alias("h"), F.sqrt(1.0 + F.coalesce("drivers", F.lit(0))).alias("root"))
    sent = edges.join(own.select("circuit_id", F.col("idx").alias("drv"), *((F.col("h")[k] / F.col("root")).alias(f"h{k}") for k in range(size))), ["circuit_id", "drv"])
    got = sent.groupBy("circuit_id", F.col("snk").alias("idx")).agg(*(F.sum(f"h{k}").alias(f"h{k}") for k in range(size)))
    out = own.join(got, ["circuit_id", "idx"], "left").select("circuit_id", "idx", "v", *(((F.col("h")[k] / F.col("root") + F.coalesce(f"h{k}", F.lit(0.0))) / F.col("root")).alias(f"o{k}") for k in range(size)))
    moments = out.agg(*(F.avg(f"o{k}").alias(f"mean{k}") for k in range(size)), *(F.var_pop(f"o{k}").alias(f"var{k}") for k in range(size)))
    out = out.join(F.broadcast(moments))  # one row

    def one(k: int) -> Column:
        z = (F.col(f"o{k}") - F.col(f"mean{k}")) / F.sqrt(F.col(f"var{k}") + epsilon)
        return F.col("v")[k] + F.when(z > 0, z).otherwise(F.expm1(z))

    return out.select("circuit_id", "idx", F.array(*(one(k) for k in range(size))).alias("v"))


def edge_sums(vectors: DataFrame, arcs: DataFrame, term: Callable[[int], Column], size: int, epsilon: float = 0.0) -> DataFrame:
    """(circuit_id, idx, v): (1 + epsilon) times the own vector plus the sum of the rectified driver vectors plus edge terms."""
    sent = arcs.join(vectors.withColumnRenamed("idx", "drv"), ["circuit_id", "drv"]).groupBy("circuit_id", F.col("snk").alias("idx"))
    got = sent.agg(*(F.sum(F.greatest(F.col("v")[k] + term(k), F.lit(0.0))).alias(f"s{k}") for k in range(size)))
    return vectors.join(got, ["circuit_id", "idx"], "left").select("circuit_id", "idx", F.array(*((1.0 + epsilon) * F.col("v")[k] + F.coalesce(f"s{k}", F.lit(0.0)) for k in range(size))).alias("v"))
