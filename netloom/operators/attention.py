"""Attention between all nodes of a circuit, blocks that join it with local sums, and the fused embedding.

Nodes of a circuit are dealt into blocks. A task takes a block of asking and a block of answering nodes and returns,
for each asking node and head, the greatest score, the sum of the exponentials above it and the weighted vector. Those
merge exactly (the sums are shifted to the greatest of the maxima), so no row for a pair of nodes is ever made. Rows that
cross the shuffle: a node once for each block it meets, so a circuit of n nodes sends n * n / block rows; that is what the
operator computes, and the block is a parameter. Only circuits of more than WHOLE nodes are dealt so: smaller ones cross
the shuffle once and are attended by the task that holds them, which is the same sum without its parts.

Vectors are (circuit_id, idx, v array<double>). Dense layers are matrix products over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .timing import _bucketed, _by_size, _numbered, _place

VECTORS = "circuit_id long, idx long, v array<double>"
#: Circuits of at most so many nodes are attended in one piece; a task holds the square of it in scores at once.
WHOLE = 2048


def matrix(column: pa.Array) -> np.ndarray:
    """The arrays of a column as rows; all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim > 1 else 0)), pa.array(m.ravel()))


def mapped(rows: DataFrame, f: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """(circuit_id, idx, v): v is f of the matrices of these columns (v alone if none are named)."""
    names = columns or ("v",)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = f(*(matrix(batch.column(c)) for c in names))
                yield pa.RecordBatch.from_arrays([batch.column("circuit_id"), batch.column("idx"), arrays(out)], ["circuit_id", "idx", "v"])

    return rows.select("circuit_id", "idx", *names).mapInArrow(run, VECTORS)


def layer_norm(v: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    return (v - v.mean(1, keepdims=True)) / np.sqrt(v.var(1, keepdims=True) + epsilon)


def gelu(v: np.ndarray) -> np.ndarray:
    """In the form with tanh."""
    return 0.5 * v * (1 + np.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v**3)))


def two_layers(v: np.ndarray, w: dict, name: str) -> np.ndarray:
    return gelu(v @ w[f"{name}1"].T) @ w[f"{name}2"].T


def _meet(heads: int, q: np.ndarray, k: np.ndarray, v: np.ndarray):
    """For each asking row: greatest score and sum of exponentials by head, weighted vectors of all heads."""
    top, total, out = [], [], []
    for h in range(heads):
        part = slice(h * q.shape[1] // heads, (h + 1) * q.shape[1] // heads)
        s = q[:, part] @ k[:, part].T / np.sqrt(q[:, part].shape[1])
        m = s.max(1)
        e = np.exp(s - m[:, None])
        top.append(m), total.append(e.sum(1)), out.append(e @ v[:, part])
    return np.stack(top, 1), np.stack(total, 1), np.concatenate(out, 1)


def _attended(heads: int, ids: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The weighted vectors of all nodes of whole circuits, whose rows stand together; circuits of one size are one product,
    of which no part has more than WHOLE * WHOLE scores."""
    out, starts = np.empty_like(v), np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    sizes = np.diff(np.r_[starts, len(ids)]) if len(ids) else starts[:0]
    for n in np.unique(sizes):
        every, some, strip = starts[sizes == n], max(1, WHOLE * WHOLE // int(n * n)), max(1, WHOLE * WHOLE // int(n))
        for at in range(0, len(every), some):
            rows = every[at : at + some, None] + np.arange(n)
            for begin in range(0, n, strip):
                asking = rows[:, begin : begin + strip]
                for h in range(heads):
                    part = slice(h * v.shape[1] // heads, (h + 1) * v.shape[1] // heads)
                    s = q[asking, part] @ k[rows, part].transpose(0, 2, 1) / np.sqrt(part.stop - part.start)
                    s = np.exp(s - s.max(2, keepdims=True))
                    out[asking, part] = s @ v[rows, part] / s.sum(2, keepdims=True)
    return out


def _in_one_piece(vectors: DataFrame, w: dict[str, np.ndarray], heads: int) -> DataFrame:
    """global_attention() of circuits that each fit one task: rows are sorted by circuit, and one is worked when it is all there."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            rows = pa.Table.from_batches(held)
            x = matrix(rows.column("v"))
            out = _attended(heads, rows.column("circuit_id").to_numpy(), x @ w["q"].T, x @ w["k"].T, x @ w["v"].T)
            return pa.Table.from_arrays([rows.column("circuit_id"), rows.column("idx"), arrays(out @ w["o"].T)], ["circuit_id", "idx", "v"]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("circuit_id").to_numpy()
            begun = int(np.searchsorted(ids, ids[-1]))  # where the batch's last circuit begins
            if begun or (held and held[-1].column("circuit_id")[0].as_py() != ids[0]):
                held.append(batch.slice(0, begun))
                yield from done()
                held = []
            held.append(batch.slice(begun))
        if held:
            yield from done()

    return vectors.select("circuit_id", "idx", "v").repartition("circuit_id").sortWithinPartitions("circuit_id").mapInArrow(run, VECTORS)


def global_attention(vectors: DataFrame, w: dict[str, np.ndarray], heads: int, block: int = 4096, whole: int = WHOLE) -> DataFrame:
    """(circuit_id, idx, v): each node's vector after attention to all nodes of its circuit; w has q, k, v and o.

    Circuits of more than `whole` nodes are dealt into blocks.
    """
    from ..sources.tables import checkpointed

    vectors = vectors.where("circuit_id IS NOT NULL")
    large = checkpointed(vectors.groupBy("circuit_id").count().where(F.col("count") > whole).select("circuit_id"))
    if large.isEmpty():
        return _in_one_piece(vectors, w, heads)
    small = _in_one_piece(vectors.join(large, "circuit_id", "left_anti"), w, heads)
    return small.unionByName(_in_blocks(vectors.join(large, "circuit_id", "left_semi"), w, heads, block))


def _in_blocks(vectors: DataFrame, w: dict[str, np.ndarray], heads: int, block: int) -> DataFrame:
    """global_attention() of circuits that no task holds as a whole."""
    sizes = vectors.groupBy("circuit_id").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
    rows = vectors.join(sizes, "circuit_id").withColumn("own", F.pmod(F.xxhash64("idx"), F.col("of")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    asking = rows.select("circuit_id", "idx", "v", F.col("own").alias("i"), every.alias("j")).groupBy("circuit_id", "i", "j")
    answering = rows.select(F.col("circuit_id").alias("circuit_id"), F.col("v").alias("v"), every.alias("i"), F.col("own").alias("j")).groupBy("circuit_id", "i", "j")
    size = w["q"].shape[0]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"circuit_id": pa.array([], pa.int64()), "idx": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(pa.float64())) for c in ("top", "total", "out")}})
        x, y = matrix(a.column("v")), matrix(b.column("v"))
        found = _meet(heads, x @ w["q"].T, y @ w["k"].T, y @ w["v"].T)
        return pa.table({"circuit_id": a.column("circuit_id"), "idx": a.column("idx"), **{c: arrays(m) for c, m in zip(("top", "total", "out"), found)}})

    met = asking.cogroup(answering).applyInArrow(run, "circuit_id long, idx long, top array<double>, total array<double>, out array<double>")
    node = Window.partitionBy("circuit_id", "idx")  # a row for each block
    met = met.select("*", *(F.max(F.col("top")[h]).over(node).alias(f"m{h}") for h in range(heads)))
    shift = [F.exp(F.col("top")[h] - F.col(f"m{h}")) for h in range(heads)]
    totals = [F.sum(F.col("total")[h] * shift[h]) for h in range(heads)]
    merged = met.groupBy("circuit_id", "idx").agg(F.array(*(F.sum(F.col("out")[k] * shift[k * heads // size]) / totals[k * heads // size] for k in range(size))).alias("v"))
    return mapped(merged, lambda v: v @ w["o"].T)


def local_sums(vectors: DataFrame, arcs: DataFrame, w: dict[str, np.ndarray], epsilon: float = 0.0) -> DataFrame:
    """(circuit_id, idx, v): (1 + epsilon) times the own vector plus the sum of the rectified driver vectors with edge
    terms, through two layers; arcs have e array<double>."""
    size = w["edge"].shape[0]
    sent = arcs.select("circuit_id", "drv", F.col("snk").alias("idx"), "e").join(vectors.withColumnRenamed("idx", "drv"), ["circuit_id", "drv"])
    sent = mapped(sent, lambda v, e: np.maximum(v + e @ w["edge"].T, 0.0), "v", "e")
    got = sent.groupBy("circuit_id", "idx").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(size))).alias("s"))
    both = vectors.join(got, ["circuit_id", "idx"], "left").withColumn("s", F.coalesce("s", F.array_repeat(F.lit(0.0), size)))
    return mapped(both, lambda v, s: two_layers((1 + epsilon) * v + s, w, "local"), "v", "s")


def gps_block(vectors: DataFrame, arcs: DataFrame, w: dict[str, np.ndarray], heads: int, block: int = 4096) -> DataFrame:
    """Vector plus local sums plus attention, both of the normalised vector; then plus two layers of it, normalised.

    Nodes and arcs of circuits that a task holds cross the shuffle once; larger ones are joined and dealt into blocks.
    """
    from ..sources.tables import checkpointed

    def close(v, near, far):
        v = v + near + far
        return v + two_layers(layer_norm(v), w, "ffn")

    def run(n: pa.Table, a: pa.Table) -> pa.Table:
        ids = [n.column(c).to_numpy() for c in ("circuit_id", "idx")]
        numbers = _numbered(*ids)
        (circuit, idx), v = (x[numbers[3]] for x in ids), matrix(n.column("v"))[numbers[3]]
        if n.num_rows:
            normal, sums = layer_norm(v), np.zeros_like(v)
            if a.num_rows:
                (drv, x), (snk, y) = (_place(numbers, a.column("circuit_id").to_numpy(), a.column(end).to_numpy()) for end in ("drv", "snk"))
                np.add.at(sums, snk[x & y], np.maximum(normal[drv[x & y]] + matrix(a.column("e"))[x & y] @ w["edge"].T, 0.0))
            far = _attended(heads, circuit, normal @ w["q"].T, normal @ w["k"].T, normal @ w["v"].T) @ w["o"].T
            v = close(v, two_layers(normal + sums, w, "local"), far)
        return pa.table({"circuit_id": circuit, "idx": idx, "v": arrays(v)})

    def small(nodes: DataFrame, edges: DataFrame, buckets: int) -> DataFrame:
        nodes, edges = (_bucketed(x, buckets).groupBy("bucket") for x in (nodes, edges))
        return nodes.cogroup(edges).applyInArrow(run, VECTORS)

    def large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        keys, normal = ["circuit_id", "idx"], checkpointed(mapped(nodes, layer_norm))
        both = nodes.join(local_sums(normal, edges, w).withColumnRenamed("v", "near"), keys).join(_in_blocks(normal, w, heads, block).withColumnRenamed("v", "far"), keys)
        return mapped(both, close, "v", "near", "far")

    return checkpointed(_by_size(vectors.select("circuit_id", "idx", "v"), arcs.select("circuit_id", "drv", "snk", "e"), small, large))


def fused_embedding(timing: DataFrame, features: DataFrame, places: DataFrame, arcs: DataFrame, w: dict[str, np.ndarray], blocks: list[dict], heads: int, block: int = 4096) -> DataFrame:
    """(circuit_id, idx, v): the timing embedding and a stack of attention blocks, through two layers of the timing's width.

    The stack starts from the features and the structural encoding (places), each through its weights.
    """
    keys = ["circuit_id", "idx"]
    from ..sources.tables import checkpointed

    h = checkpointed(mapped(features.join(places.withColumnRenamed("v", "pe"), keys), lambda v, pe: v @ w["features"].T + pe @ w["places"].T, "v", "pe"))
    for part in blocks:
        h = gps_block(h, arcs, part, heads, block)
    both = timing.withColumnRenamed("v", "t").join(h, keys)
    return mapped(both, lambda t, v: two_layers(np.concatenate([t, layer_norm(v)], 1), w, "fuse"), "t", "v")


def edge_attention(vectors: DataFrame, edges: DataFrame, w: dict[str, np.ndarray], heads: int, slope: float = 0.2, matching: int | None = None) -> DataFrame:
    """(circuit_id, idx, v): for each head the driver vectors of a node, weighed by a softmax over its edges.

    edges: circuit_id, drv, snk, e array<double>; two edges between the same ends are weighed apart. A score is the sum of
    w["a"] (a row for each head) times the leaky-rectified sum of driver (w["l"]), sink (w["r"]) and edge (w["e"]) projections,
    plus w["symmetry"] of the head times column `matching` of the edge. A node without drivers gets zeros.
    """
    size = w["l"].shape[0]
    ends = edges.select("circuit_id", "drv", F.col("snk").alias("idx"), "e")
    ends = ends.join(vectors.select("circuit_id", F.col("idx").alias("drv"), F.col("v").alias("x")), ["circuit_id", "drv"]).join(vectors.select("circuit_id", "idx", F.col("v").alias("y")), ["circuit_id", "idx"])

    def scored(x, y, e):
        sent = x @ w["l"].T
        z = sent + y @ w["r"].T + e @ w["e"].T
        z = np.where(z > 0, z, slope * z).reshape(len(z), heads, -1)
        score = (z * w["a"]).sum(2)
        if matching is not None:
            score = score + w["symmetry"] * e[:, [matching]]
        return np.concatenate([score, sent], 1)

    rows = mapped(ends, scored, "x", "y", "e")
    node = Window.partitionBy("circuit_id", "idx")  # the drivers of one node
    rows = rows.select("*", *(F.max(F.col("v")[h]).over(node).alias(f"m{h}") for h in range(heads)))
    weight = [F.exp(F.col("v")[h] - F.col(f"m{h}")) for h in range(heads)]
    totals = [F.sum(x) for x in weight]
    got = rows.groupBy("circuit_id", "idx").agg(F.array(*(F.sum(F.col("v")[heads + k] * weight[k * heads // size]) / totals[k * heads // size] for k in range(size))).alias("v"))
    return vectors.select("circuit_id", "idx").join(got, ["circuit_id", "idx"], "left").select("circuit_id", "idx", F.coalesce("v", F.array_repeat(F.lit(0.0), size)).alias("v"))


def attention_stack(vectors: DataFrame, edges: DataFrame, layers: list[dict[str, np.ndarray]], heads: int, matching: int | None = None, epsilon: float = 1e-5) -> DataFrame:
    """Layers of edge_attention(), each normalised over all nodes and rectified exponentially; from the second on the layer's
    input is added, so all later layers have one width."""
    from ..sources.tables import checkpointed

    for k, w in enumerate(layers):
        size = w["l"].shape[0]
        out = checkpointed(edge_attention(vectors, edges, w, heads, matching=matching))
        moments = out.agg(*(F.avg(F.col("v")[i]) for i in range(size)), *(F.var_pop(F.col("v")[i]) for i in range(size))).first()  # two numbers for each dimension
        mean, var = (np.array([x or 0.0 for x in part]) for part in (moments[:size], moments[size:]))

        def rectified(v, before=None, mean=mean, var=var):
            z = (v - mean) / np.sqrt(var + epsilon)
            z = np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
            return z if before is None else z + before

        if k:
            vectors = mapped(out.join(vectors.withColumnRenamed("v", "before"), ["circuit_id", "idx"]), rectified, "v", "before")
        else:
            vectors = mapped(out, rectified)
        vectors = checkpointed(vectors)
    return vectors
