"""Vector similarity: exact top-k for a stated query set, pair comparison, and a clustered index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def _best(k: int):
    """A cogroup function: the k rows of the second table most similar to each of the first, ties to the smaller id."""
    names = ["query_id", "vec_id", "similarity"]

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        x, y = (np.array(t.column("embedding").to_pylist(), np.float64) for t in (q, r))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        of, ids = q.column("vec_id").to_numpy(), r.column("vec_id").to_numpy()
        s = np.round(x @ y.T, 6)
        s[of[:, None] == ids[None, :]] = -np.inf
        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))  # k for each query, and those that tie with the last
        by = np.lexsort((ids[j], -s[i, j], i))
        i, j = i[by], j[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        return pa.table([pa.array(of[i]), pa.array(ids[j]), pa.array(s[i, j])], names)

    return run


def topk(queries: DataFrame, rows: DataFrame, k: int, block: int = 2048, within: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, similarity): the k most similar other vectors; ties go to the smaller id.

    Queries and rows are dealt into blocks; each two blocks meet in one task as a matrix product that keeps k rows for
    each query, so no row for each pair is ever made. With `within`, only rows with the query's value of it are searched.
    """
    keys = [within] if within else []
    over, under = (max(1, math.ceil(x.count() / block)) for x in (queries, rows))

    def dealt(x: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own)
        return x.select("vec_id", "embedding", *keys, place, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    met = dealt(queries, "i", over, "j", under).groupBy(*keys, "i", "j").cogroup(dealt(rows, "j", under, "i", over).groupBy(*keys, "i", "j"))
    return _ranked(met.applyInArrow(_best(k), "query_id long, vec_id long, similarity double"), k)


def compare(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of each pair (a, b) and the difference of their labels."""
    a, b = (rows.select(F.col("vec_id").alias(k), F.col("embedding").alias(f"v_{k}"), F.col("label").alias(f"l_{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", F.round(cosine("v_a", "v_b"), 6).alias("similarity"), (F.col("l_b") - F.col("l_a")).cast("long").alias("label_delta"))


def compare_deltas(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of each pair (a, b), NaN where a vector is zero, and b - a of label, norm, mean and greatest component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    facts = rows.select("vec_id", "label", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("mean"), F.array_max(v).alias("top"))
    a, b = (facts.select(F.col("vec_id").alias(k), F.struct("embedding", "label", "norm", "mean", "top").alias(f"f_{k}")) for k in "ab")
    both, delta = pairs.join(a, "a").join(b, "b"), lambda c: F.col(f"f_b.{c}") - F.col(f"f_a.{c}")
    nonzero = (F.col("f_a.norm") > 0) & (F.col("f_b.norm") > 0)
    similarity = F.when(nonzero, dot("f_a.embedding", "f_b.embedding") / (F.col("f_a.norm") * F.col("f_b.norm"))).otherwise(F.lit(float("nan")))
    return both.select("a", "b", F.round(similarity, 6).alias("similarity"), delta("label").cast("long").alias("label_delta"), *((F.round(delta(c), 5) + 0.0).alias(f"{c}_delta") for c in ("norm", "mean", "top")))


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _probes(units: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 200) -> int:
    """How many cells must be searched so that `recall` of the exact neighbours are found, measured inside a sample."""
    queries = units[:: max(1, len(units) // asked)][:asked]
    cell = ((units[:, None, :] * centres[None]).sum(2) - (centres**2).sum(1) / 2).argmax(1) if len(units) * len(centres) * units.shape[1] < 5e7 else np.concatenate([(u @ centres.T - (centres**2).sum(1) / 2).argmax(1) for u in np.array_split(units, 64)])
    near = np.argsort(-(queries @ centres.T - (centres**2).sum(1) / 2), axis=1)
    best = np.argsort(-(queries @ units.T), axis=1)[:, 1 : k + 1]
    place = (near[:, :, None] == cell[best][:, None, :]).argmax(1)  # how many cells come before that of each neighbour
    return int(np.quantile(place, recall, method="higher")) + 1


def ivf_topk(queries: DataFrame, rows: DataFrame, k: int, sample: int = 20_000, recall: float = 0.97, block: int = 2048) -> DataFrame:
    """Top k over the cells nearest to each query: approximate, with the probes that give the wanted recall on the sample.

    Centres and probes are fitted on a bounded sample (the rows of least hash); every row is indexed. A cell of more than
    `block` rows is cut into blocks, and each meets its queries in one task as a matrix product.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    lists = min(1024, int(math.sqrt(n)))
    if lists < 2:  # one cell
        return topk(queries, rows, k)
    unit = F.transform("embedding", lambda x: x.cast("double") / F.greatest(F.sqrt(dot("embedding", "embedding")), F.lit(1e-12)))
    part = rows.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding", array_to_vector(unit).alias("f"))
    centres = np.array(KMeans(k=lists, seed=1, maxIter=5, featuresCol="f").fit(part).clusterCenters())
    units = _units(np.array(part.select("embedding").toArrow().column(0).to_pylist(), np.float64))  # `sample` vectors at most
    probes = _probes(units, centres, k, recall)

    def cells(count):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    v = _units(np.array(batch.column("embedding").to_pylist(), np.float64))
                    near = np.argsort(-(v @ centres.T - (centres**2).sum(1) / 2), axis=1)[:, :count]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(near.tolist(), pa.list_(pa.int32()))], ["vec_id", "embedding", "cells"])

        return run

    schema = "vec_id long, embedding array<float>, cells array<int>"
    index = rows.select("vec_id", "embedding").mapInArrow(cells(1), schema).select("vec_id", "embedding", F.col("cells")[0].alias("cell"))
    blocks = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("of")))  # a row for each of at most 1024 cells
    asked = queries.select("vec_id", "embedding").mapInArrow(cells(probes), schema).select("vec_id", "embedding", F.explode("cells").alias("cell"))
    asked = asked.join(blocks, "cell").select("vec_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("j"))
    held = index.join(blocks, "cell").select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("of")).cast("int").alias("j"))
    met = asked.groupBy("cell", "j").cogroup(held.groupBy("cell", "j"))
    return _ranked(met.applyInArrow(_best(k), "query_id long, vec_id long, similarity double"), k)
