"""Message passing on circuit graphs: gather along edges, then reduce for each destination and dimension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.library import WIRE_REF


def _dims(size: int, make) -> list[Column]:
    return [make(k) for k in range(size)]


def wire_term(k: int) -> Column:
    """What an edge adds to every dimension: its wire delay."""
    return F.col("wire_delay") / WIRE_REF


def matrix_term(weights: list[list[float]], columns: list[str]) -> Callable[[int], Column]:
    """What an edge adds to dimension k: row k of `weights` times the edge's columns."""
    return lambda k: sum((w * F.col(c) for w, c in zip(weights[k][1:], columns[1:])), weights[k][0] * F.col(columns[0]))


def aggregate_messages(vectors: DataFrame, arcs: DataFrame, how: str, size: int = 3, sign: float = 1.0, beta: float = 1.0, term: Callable[[int], Column] = wire_term) -> DataFrame:
    """(circuit_id, idx, m0..): reduce driver vector +/- the edge's term over the drivers of each node.

    how is max, min, soft or softmin; soft is max + log(sum(exp(beta * (m - max)))) / beta, in two steps for stability,
    and softmin the same of the negated messages, negated.
    """
    sent = arcs.join(vectors.withColumnRenamed("idx", "drv"), ["circuit_id", "drv"]).select("circuit_id", F.col("snk").alias("idx"), *_dims(size, lambda k: (F.col("v")[k] + sign * term(k)).alias(f"m{k}")))
    if how in ("soft", "softmin"):
        turn = 1.0 if how == "soft" else -1.0
        w = Window.partitionBy("circuit_id", "idx")
        for k in range(size):
            sent = sent.withColumn(f"m{k}", turn * F.col(f"m{k}")).withColumn(f"x{k}", F.max(f"m{k}").over(w))
        return sent.groupBy("circuit_id", "idx").agg(*_dims(size, lambda k: F.round(turn * (F.max(f"m{k}") + F.log(F.greatest(F.sum(F.exp(beta * (F.col(f"m{k}") - F.col(f"x{k}")))), F.lit(1e-12))) / beta), 9).alias(f"m{k}")))
    reduce = {"max": F.max, "min": F.min}[how]
    return sent.groupBy("circuit_id", "idx").agg(*_dims(size, lambda k: F.round(reduce(f"m{k}"), 9).alias(f"m{k}")))


def attention(vectors: DataFrame, edges: DataFrame, size: int = 3, slope: float = 0.2) -> DataFrame:
    """Softmax for each destination of the summed leaky-rectified sums of both ends' vectors."""
    a, b = (vectors.select("circuit_id", F.col("idx").alias(end), F.col("v").alias(f"v_{end}")) for end in ("drv", "snk"))
    both = [F.col("v_drv")[k] + F.col("v_snk")[k] for k in range(size)]
    score = sum((F.greatest(x, slope * x) for x in both[1:]), F.greatest(both[0], slope * both[0]))
    w = Window.partitionBy("circuit_id", "snk")
    s = edges.join(a, ["circuit_id", "drv"]).join(b, ["circuit_id", "snk"]).select("circuit_id", "drv", "snk", score.alias("s"))
    s = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return s.select("circuit_id", "drv", "snk", F.round(F.col("e") / F.sum("e").over(w), 9).alias("weight"))


def pool(vectors: DataFrame, size: int = 3) -> DataFrame:
    """Mean and maximum of each dimension over a circuit's nodes."""
    return vectors.groupBy("circuit_id").agg(*_dims(size, lambda k: F.round(F.avg(F.col("v")[k]), 9).alias(f"mean{k}")), *_dims(size, lambda k: F.round(F.max(F.col("v")[k]), 9).alias(f"max{k}")))


def structural_encoding(nodes: DataFrame, edges: DataFrame, powers=tuple(range(1, 17))) -> DataFrame:
    """Powers of the inverse undirected degree."""
    ends = edges.select("circuit_id", F.col("drv").alias("idx")).unionByName(edges.select("circuit_id", F.col("snk").alias("idx")))
    degree = ends.groupBy("circuit_id", "idx").agg(F.count("*").alias("degree"))
    d = nodes.select("circuit_id", "idx").join(degree, ["circuit_id", "idx"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return d.select("circuit_id", "idx", "degree", *(F.round(F.pow(1.0 / F.greatest("degree", F.lit(1)), F.lit(p)), 9).alias(f"pe{p}") for p in powers))


def relax_sweeps(vectors: DataFrame, arcs: DataFrame, sweeps: int, size: int = 3, how: str = "max", sign: float = 1.0, term: Callable[[int], Column] = wire_term) -> DataFrame:
    """`sweeps` rounds of max (min) messages, each combined with the node's own vector by elementwise maximum (minimum)."""
    from ..sources.tables import checkpointed

    better = {"max": F.greatest, "min": F.least}[how]
    for _ in range(sweeps):
        m = aggregate_messages(vectors, arcs, how, size, sign, term=term)
        m = m.select("circuit_id", "idx", F.array(*(f"m{k}" for k in range(size))).alias("m"))
        vectors = checkpointed(vectors.join(m, ["circuit_id", "idx"], "left").select("circuit_id", "idx", F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda x, y: better(x, y))).alias("v")))
    return vectors
