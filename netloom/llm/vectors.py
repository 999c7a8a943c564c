"""Near-duplicate embeddings by collision counting on one-dimensional projections.

Unit vectors are projected on `projections` random Gaussian directions. Two vectors collide on a direction if one lies
in the window of half-width w around the other. Pairs that collide on at least projections - misses directions are
verified by their cosine in double precision. w is calibrated: a pair just at the threshold reaches the count with
probability `recall`, a more similar one with more.

A window of one direction holds a fixed part of all vectors, so pairs are counted inside tables: each table sorts the
vectors by several further projections jointly, cut into cells, and only vectors of one cell are counted against each
other. A cell takes as many directions as leave about `load` unrelated vectors in it, and there are as many tables as
bring a pair at the threshold into one cell somewhere with probability `recall`; so the pairs counted grow with a power
of the rows well below two. A pair that shares several cells counts in the first of them alone.

Equal vectors are one representative with a number of copies before that. A cell with more than BLOCK vectors is cut into
blocks, and each two of them meet in a task of their own; they return a sum of links for each vector and one edge for
each vector to the least id of its part, never a row for each pair.

Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept. Vectors of
different lengths do not link. A vector is scaled by its largest component first, so that its square neither overflows
nor vanishes. Rows that repeat an id and a vector are copies of each other under one id; an id with different vectors
counts as one vector for each of them and gets the most links that one of them has and the least component. Keys may be integers or text; component_id is the
least key of its component. Null keys are dropped. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import numbered, salted, written
from .textops import U64, mix64

#: Vectors of a cell that meet in one task.
BLOCK = 2048
#: Width of a cell in distances of a pair at the threshold.
CELL = 4.0


def window(threshold: float, projections: int, misses: int, recall: float) -> float:
    """Half-width at which a pair of cosine `threshold` misses at most `misses` windows with probability `recall`."""
    distance, low, high = math.sqrt(2 - 2 * threshold), 0.0, 20.0
    for _ in range(100):
        z = (low + high) / 2
        q = math.erfc(z / math.sqrt(2))
        reached = sum(math.comb(projections, k) * q**k * (1 - q) ** (projections - k) for k in range(misses + 1))
        low, high = (z, high) if reached < recall else (low, z)
    return high * distance


def together(distance: float, width: float) -> float:
    """Probability that two vectors of that distance share a cell of that width on a random direction with a random shift."""
    z = width / distance
    return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))


def tables_for(rows: int, threshold: float, recall: float, load: int) -> tuple[int, int]:
    """How many directions make a cell, and how many tables there are, for so many vectors."""
    near = math.sqrt(2 - 2 * threshold)
    width = CELL * near
    depth = max(1, math.ceil(math.log(max(rows / load, 1)) / -math.log(together(math.sqrt(2), width))))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - together(near, width) ** depth))


def directions(size: int, projections: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, projections))


def codes(x: np.ndarray, threshold: float, depth: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table, as a hash."""
    size, width = x.shape[1], CELL * math.sqrt(2 - 2 * threshold)
    shift = np.random.default_rng([11, size]).random(depth * tables)
    cell = np.floor(x @ directions(size, depth * tables, 13) / width + shift).astype(np.int64).view(U64).reshape(len(x), tables, depth)
    out = np.zeros((len(x), tables), U64) + np.arange(tables, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            out = mix64(out * U64(0x9E3779B97F4A7C15) + cell[:, :, k])
    return out


def _unit(values: pa.Array, size: int, kind) -> np.ndarray:
    x = np.frombuffer(b"".join(values.to_pylist()), kind).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, w: float, least: int, threshold: float, same: bool, block: int = 256):
    """Numbers of the linked pairs of two sets with projections px and py; with `same`, each pair once."""
    out, m = [], px.shape[1]
    px, py = np.ascontiguousarray(px.T, np.float32), np.ascontiguousarray(py.T, np.float32)
    wide = np.float32(w * 1.00001 + 1e-6)
    for a in range(0, len(x), block):
        for b in range(a if same else 0, len(y), block):
            p, q = px[:, a : a + block], py[:, b : b + block]
            missed = np.zeros((p.shape[1], q.shape[1]), np.uint8)
            dense = min(m, 6)
            for k in range(dense):
                missed += np.abs(p[k][:, None] - q[k][None, :]) > wide
            i, j = np.nonzero(missed <= m - least)
            missed = missed[i, j]
            for k in range(dense, m):
                missed = missed + (np.abs(p[k][i] - q[k][j]) > wide)
                ok = missed <= m - least
                i, j, missed = i[ok], j[ok], missed[ok]
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 100_000):
                s, t = i[c : c + 100_000], j[c : c + 100_000]
                cos = np.einsum("ij,ij->i", x[s], y[t])
                out.append((s[cos >= threshold], t[cos >= threshold]))
    return tuple(np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out) if out else ((), ())))


def parts(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable from each of ids by the links (i, j)."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, projections: int = 20, misses: int = 1, recall: float = 0.999, load: int = 256) -> DataFrame:
    """key, n_links, component_id (least key reachable by links), kept."""
    table, keys = numbered(table.select(F.col(key).alias("__k"), F.col(vector).alias("v")), "__k")
    rows = table.select(F.col("__id").alias("id"), "v").distinct()
    kind = np.float32 if "array<float>" in rows.schema["v"].dataType.simpleString() else np.float64
    v = F.col("v").cast("array<double>")
    fine = (F.size("v") > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})

    def packed(batches):
        for batch in batches:
            flat = batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(kind)
            n = np.concatenate([[0], np.cumsum(batch.column("v").value_lengths().to_numpy())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(np.diff(n)), pa.array([flat[a:b].tobytes() for a, b in zip(n, n[1:])], pa.binary())], ["rep", "n", "size", "v"])

    classes = written(rows.where("fine").groupBy("h", "h2", "v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n")), "classes")
    reps = written(classes.select("rep", "n", "v").mapInArrow(packed, "rep long, n long, size long, v binary"), "reps")
    w, least = window(threshold, projections, misses, recall), projections - misses
    links, edges = [], []
    for size, count in reps.groupBy("size").count().collect():  # a row for each vector length
        depth, tables = tables_for(count, threshold, recall, load)
        found = written(_links(reps.where(F.col("size") == size), size, kind, w, least, threshold, projections, depth, tables), "links")
        links.append(found.where("y IS NULL").select("x", "n"))
        edges.append(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b")))
    reach = salted(rows.where("fine").select("id", "h", "h2"), classes.select("h", F.col("h2").alias("c2"), "rep", F.col("n").alias("copies")), "h", "id", 16).where("h2 = c2").select("id", "rep", "copies")  # 128 bits stand for the vector
    result = reach.unionByName(rows.where("NOT fine").select("id", F.lit(None).cast("long").alias("rep"), F.lit(1).cast("long").alias("copies")))
    others, part = "rep long, others long", "rep long, component long"
    if links:
        for x, y in zip(links[1:], edges[1:]):
            links[0], edges[0] = links[0].unionByName(x), edges[0].unionByName(y)
        others = links[0].groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("others"))
        part = components(edges[0]).withColumnsRenamed({"v": "rep", "c": "component"})
    else:
        others, part = (table.sparkSession.createDataFrame([], s) for s in (others, part))
    result = result.join(others, "rep", "left").join(part, "rep", "left")
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    result = result.groupBy("id").agg(F.max(n_links).cast("long").alias("n_links"), F.min(F.coalesce("component", "rep", "id")).alias("component_id"))
    if keys is not None:
        result = result.join(keys, F.col("id") == F.col("__id")).select("__key", "n_links", "component_id")
        least_key = result.groupBy("component_id").agg(F.min("__key").alias("least"))
        result = result.join(least_key, "component_id").select(F.col("__key").alias("id"), "n_links", F.col("least").alias("component_id"))
    return result.select(F.col("id").alias(key), "n_links", "component_id", (F.col("component_id") == F.col("id")).alias("kept"))


def _links(reps: DataFrame, size: int, kind, w: float, least: int, threshold: float, projections: int, depth: int, tables: int) -> DataFrame:
    """(x, y, n): links of x in one pair of blocks (y null), or an edge from x to y."""

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = codes(_unit(batch.column("v"), size, kind), threshold, depth, tables)
            for t in range(tables):
                before = pa.array([c.tobytes() for c in cell[:, :t]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell[:, t].view(np.int64)), before, *(batch.column(c) for c in ("rep", "n", "v"))], ["t", "cell", "before", "rep", "n", "v"])

    dealt = written(reps.select("rep", "n", "v").mapInArrow(deal, "t int, cell long, before binary, rep long, n long, v binary"), "cells")
    sizes = written(dealt.groupBy("t", "cell").agg(F.count("*").alias("rows")).where("rows > 1"), "cell-sizes")
    small = dealt.join(sizes.where(F.col("rows") <= BLOCK), ["t", "cell"], "left_semi").select("*", *(F.lit(0).alias(c) for c in ("k", "i", "j")))
    large = sizes.where(F.col("rows") > BLOCK).select(F.xxhash64("t", "cell").alias("h"), F.col("t").alias("ct"), F.col("cell").alias("cc"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("of"))
    blocks = salted(dealt.withColumn("h", F.xxhash64("t", "cell")), large, "h", "rep").where("t = ct AND cell = cc").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumns({"i": F.least("k", "other"), "j": F.greatest("k", "other")})
    rows = small.unionByName(blocks.select(small.columns)).repartition("t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j")
    g = directions(size, projections)

    def meet(table: pa.RecordBatch | pa.Table):
        t, i, j = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
        x, k = _unit(table.column("v"), size, kind), table.column("k").to_numpy()
        ids, n, p = table.column("rep").to_numpy(), table.column("n").to_numpy(), x @ g
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        a, b = linked(x[left], x[right], p[left], p[right], w, least, threshold, i == j)
        a, b = left[a], right[b]
        if t and len(a):
            before = np.frombuffer(b"".join(table.column("before").to_pylist()), U64).reshape(-1, t)
            new = ~(before[a] == before[b]).any(1)
            a, b = a[new], b[new]
        total = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
        label = parts(a, b, ids)
        some, moved = np.flatnonzero(total), np.flatnonzero(label != ids)
        return np.concatenate([ids[some], ids[moved]]), np.concatenate([np.full(len(some), -1), label[moved]]), np.concatenate([total[some].astype(np.int64), np.zeros(len(moved), np.int64)]), np.r_[np.ones(len(some), bool), np.zeros(len(moved), bool)]

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = np.stack([held.column(c).to_numpy() for c in ("t", "cell", "i", "j")])
            cut = np.flatnonzero((np.diff(group, axis=1) != 0).any(0)) + 1
            yield from found([held.slice(a, b - a) for a, b in zip([0, *cut[:-1]], cut)])
            held = held.slice(cut[-1]) if len(cut) else held
        if held is not None and held.num_rows:
            yield from found([held])

    def found(groups):
        out = [meet(x) for x in groups if x.num_rows > 1]
        if out:
            x, y, n, none = (np.concatenate(z) for z in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, mask=none), pa.array(n)], ["x", "y", "n"])

    return rows.mapInArrow(run, "x long, y long, n long")
