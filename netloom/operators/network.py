"""The timing network of one batch of circuits: forward values, losses and gradients by hand, in NumPy inside tasks.

A batch is a disjoint graph: circuits one after another, node numbers offset. Node vectors pass through a layer to the
hidden size; sweeps along the edges take the greatest driver value plus an edge term (a soft maximum while training, so
that every driver gets a gradient), sweeps against the edges the least sink value less an edge term, starting from a
vector that is moved by the circuit's greatest arrival values. The embedding is both halves plus the raw vector and its
mean over the circuit through weights. Heads read halves (arrival, required) or all of it; the slack is required less
arrival time plus a residual. Inputs are standardised with the training set's figures; there is no dropout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .timing import topological_levels

# Huber width of the slack, focal weights, cap of the positive weight.
HUBER, FOCAL_ALPHA, FOCAL_GAMMA, POSITIVE_CAP = 2.0, 0.25, 2.0, 20.0
#: Each head: which part of the embedding it reads (0, 1: halves, None: all) and its loss.
HEADS = {"arrival_time": (0, "ns"), "required_time": (1, "ns"), "slack": (None, "composed"), "critical": (None, "bce"), "congestion": (None, "share"), "drc": (None, "focal")}
NS = ["slack", "arrival_time", "required_time"]
#: Exponents below it count as this much: next to the maximum's 1 both are nothing, and smaller powers are slow to take.
LEAST = -80.0


def register_head(name: str, part: int | None, loss: str) -> None:
    """A further head; its target is the column of that name."""
    if loss not in ("ns", "bce", "share", "focal") or part not in (0, 1, None):
        raise ValueError(f"no such head: {part}, {loss}")
    HEADS[name] = (part, loss)


def shapes(features: int, edge: int, hidden: int, tasks: list[str]) -> dict[str, tuple[int, ...]]:
    """Parameters by name, in the order from the input to the heads."""
    h = hidden
    out = {"in.w": (h, features), "in.b": (h,), "forward.w": (h, edge), "forward.b": (h,), "seed.w": (h, h), "seed.b": (h,), "clock.w": (h,), "clock.b": (1,), "backward.w": (h, edge), "backward.b": (h,), "raw.w": (2 * h, features), "raw.b": (2 * h,), "context.w": (2 * h, features), "context.b": (2 * h,)}
    for t in tasks:
        wide = h if HEADS[t][0] is not None else 2 * h
        out |= {f"{t}.w1": (wide, wide), f"{t}.b1": (wide,), f"{t}.w2": (wide,), f"{t}.b2": (1,)}
    return out


def distance(name: str) -> int:
    """How many layers lie between a parameter and the heads, for learning rates by layer."""
    return {"in": 3, "forward": 2, "seed": 1, "clock": 1, "backward": 1, "raw": 1, "context": 1}.get(name.split(".")[0], 0)


def initial(features: int, edge: int, hidden: int, tasks: list[str], seed: int = 0) -> dict[str, np.ndarray]:
    """Normal weights, zero shifts; the clock readout and the slack's residual begin at 0."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(features, edge, hidden, tasks).items():
        kind = name.split(".")[1]
        spread = 0.0 if kind[0] == "b" or name in ("clock.w", "slack.w2") else 0.1 if name.split(".")[0] in ("forward", "backward", "seed", "raw", "context") else shape[-1] ** -0.5
        out[name] = rng.normal(0.0, 1.0, shape) * spread
    return out


def _blocks(node: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges, in an `order` that sorts their nodes, by how many share a node: (nodes, places of their edges) for each number,
    with an edge of every node in each row, so that a sum or a maximum over a node's edges is one over the rows."""
    held = node[order]
    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(held)])
    by = np.argsort(count, kind="stable")
    cut = np.flatnonzero(np.diff(count[by])) + 1
    return [(held[first[k]], order[first[k] + np.arange(count[k[0]])[:, None]]) for k in np.split(by, cut) if len(k)]


class Direction:
    """Edges by the end that receives, and what sweeps along them need to look at.

    A sweep takes all nodes' values from those before it, and values only rise. So a node whose longest path from a node
    without edges into it has k edges is settled by sweep k, and sweep s of n tells on the last values only where a path of
    n - s edges leads on. A node is looked at from the first sweep that tells to the one that settles it, or in the latter
    alone if it comes first; the values after the last sweep are those of looking at all nodes in every one. Nodes on or
    behind a cycle are never settled, those in front of one always tell.
    """

    def __init__(self, source: np.ndarray, target: np.ndarray, other: Direction | None = None):
        """`other` is the direction against this one, if there is one."""
        if other:
            self.settled, self.onward = other.onward, other.settled
        else:
            n = int(max(source.max(initial=-1), target.max(initial=-1))) + 1
            up, down = topological_levels(source, target, n), topological_levels(target, source, n)
            self.settled, self.onward = (np.where(k < 0, np.iinfo(np.int32).max, k) for k in (up, down))
        self.source, self.target, self.by = source, target, np.argsort(source, kind="stable")
        self.into = _blocks(target, np.argsort(target, kind="stable"))

    def _open(self, sweep: int, sweeps: int) -> np.ndarray:
        """Which nodes this sweep looks at."""
        return (sweep <= self.settled) & (sweep >= np.minimum(self.settled, sweeps - self.onward))

    def sweep(self, u: np.ndarray, term: np.ndarray, beta: float | None, number: int = 1, sweeps: int = 1):
        """The greater of each node's own value and the (soft) maximum of what its sources send, for the nodes that sweep
        `number` of `sweeps` looks at; and how to go back."""
        open_, out, tape = self._open(number, sweeps), u.copy(), []
        for node, place in self.into:
            k = np.flatnonzero(open_[node])
            if not len(k):
                continue
            node, place = node[k], place[:, k]
            z = u.take(self.source[place], axis=0)
            z += term.take(place, axis=0)
            top, share = z.max(0), None
            if beta is not None and len(z) > 1:  # the share of a single source is 1
                share = np.subtract(z, top, out=z)
                share *= beta
                np.exp(np.maximum(share, LEAST, out=share), out=share)
                total = share.sum(0)
                share /= total
                top += np.log(total, out=total) / beta
            own = u.take(node, axis=0)
            out[node] = np.maximum(own, top)
            tape.append((node, place, top > own, share))
        return out, tape

    def back(self, g: np.ndarray, tape: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Gradients of the values before the sweep, and of the terms as (places of edges, gradients); a tape is used up."""
        before, sent = g.copy(), []
        for node, place, take, share in tape:
            got = g.take(node, axis=0)
            before[node] = got * ~take
            got *= take
            sent.append((place.ravel(), got if share is None else np.multiply(share, got, out=share).reshape(-1, g.shape[1])))
        if sent:
            at, row = np.full(len(self.source), -1), np.concatenate([s for _, s in sent])
            at[np.concatenate([place for place, _ in sent])] = np.arange(len(row))
            for node, place in _blocks(self.source, self.by[at[self.by] >= 0]):
                came = row.take(at[place], axis=0)
                before[node] += came[0] if len(came) == 1 else came.sum(0)
        return before, sent


class Batch:
    """Rows (n, x, drv, snk, e, y, clock) of an Arrow batch as one disjoint graph."""

    def __init__(self, rows: pa.RecordBatch, features: int, edge: int, tasks: int):
        flat = lambda c: rows.column(c).flatten().to_numpy(zero_copy_only=False)
        self.n = rows.column("n").to_numpy()
        base = np.cumsum(self.n) - self.n
        edges = np.asarray(pa.compute.list_value_length(rows.column("drv")))
        self.first = base
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        drv, snk = (flat(c) + np.repeat(base, edges) for c in ("drv", "snk"))
        self.x, self.y, e = flat("x").reshape(-1, features).astype(float), flat("y").reshape(-1, tasks).astype(float), flat("e").reshape(-1, edge).astype(float)
        self.clock = rows.column("clock").to_numpy()
        self.ways = {"forward": (way := Direction(drv, snk)), "backward": Direction(snk, drv, way)}
        self.e = e

    def mean(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.first) / self.n[:, None]


def _gelu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope, in the form with tanh."""
    k, square = np.sqrt(8 / np.pi), a * a
    share = 1 / (1 + np.exp(np.minimum(-k * a * (1 + 0.044715 * square), -LEAST)))  # half of 1 + tanh
    value = a * share
    return value, share + value * (1 - share) * (k * (1 + 3 * 0.044715 * square))


def _loss(kind: str, z: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each node and its slope by z."""
    if kind == "ns":
        return (z - y) ** 2, 2 * (z - y)
    if kind == "composed":
        d, small = z - y, np.abs(z - y) < HUBER
        return np.where(small, d * d / (2 * HUBER), np.abs(d) - HUBER / 2), np.where(small, d / HUBER, np.sign(d))
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    if kind == "share":
        return (p - y) ** 2, 2 * (p - y) * p * (1 - p)
    soft = np.logaddexp(0, -z)  # -log p
    if kind == "bce":
        return weight * y * soft + (1 - y) * (soft + z), weight * y * (p - 1) + (1 - y) * p
    a, c = FOCAL_ALPHA, FOCAL_GAMMA
    loss = np.where(y == 1, a * (1 - p) ** c * soft, (1 - a) * p**c * (soft + z))
    return loss, np.where(y == 1, a * (1 - p) ** c * (-c * p * soft - (1 - p)), (1 - a) * p**c * (p + c * (1 - p) * (soft + z)))


class Network:
    """Parameters and the figures that scale inputs and targets."""

    def __init__(self, params: dict[str, np.ndarray], tasks: list[str], sweeps: int, scale: dict):
        self.p, self.tasks, self.sweeps, self.scale = params, tasks, sweeps, scale

    def _sweeps(self, way: str, b: Batch, u: np.ndarray, beta: float | None):
        term, tapes = b.e @ self.p[f"{way}.w"].T + self.p[f"{way}.b"], []
        for number in range(1, self.sweeps + 1):
            u, tape = b.ways[way].sweep(u, term, beta, number, self.sweeps)
            tapes.append(tape)
        return u, tapes

    def forward(self, b: Batch, beta: float | None = None):
        """Raw head values by task (standardised, logits), the clock value and what going back needs. beta: None is the hard maximum."""
        p, s = self.p, self.scale
        x = (b.x - s["x_mean"]) / s["x_std"]
        a = x @ p["in.w"].T + p["in.b"]
        h = np.where(a > 0, a, np.expm1(np.minimum(a, 0)))
        arrival, up = self._sweeps("forward", b, h, beta)
        top = np.maximum.reduceat(arrival, b.first)
        clock = top @ p["clock.w"] + p["clock.b"][0]
        seed = top @ p["seed.w"].T + p["seed.b"]
        required, down = self._sweeps("backward", b, -(h + seed[b.of]), beta)
        context = b.mean(x)
        emb = np.concatenate([arrival, -required], 1) + x @ p["raw.w"].T + p["raw.b"] + (context @ p["context.w"].T + p["context.b"])[b.of]
        z, tapes, half = {}, {}, h.shape[1]
        for t in self.tasks:
            part = HEADS[t][0]
            v = emb if part is None else emb[:, part * half : (part + 1) * half]
            act, slope = _gelu(v @ p[f"{t}.w1"].T + p[f"{t}.b1"])
            z[t], tapes[t] = act @ p[f"{t}.w2"] + p[f"{t}.b2"][0], (v, act, slope)
        if "slack" in z:
            mean, std = (dict(zip(NS, s[k])) for k in ("y_mean", "y_std"))
            ns = {t: z[t] * std[t] + mean[t] for t in NS[1:] if t in z}
            base = ns["required_time"] - ns["arrival_time"] if len(ns) == 2 else mean["slack"]
            z["slack"] = (base - mean["slack"]) / std["slack"] + z["slack"]
        return z, clock, emb, (x, a, h, arrival, up, top, down, context, tapes)

    def targets(self, b: Batch) -> dict[str, np.ndarray]:
        mean, std = (dict(zip(NS, self.scale[k])) for k in ("y_mean", "y_std"))
        return {t: (b.y[:, k] - mean[t]) / std[t] if t in NS else b.y[:, k] for k, t in enumerate(self.tasks)}

    def loss(self, b: Batch, weights: dict[str, float], nodes: float, circuits: float, beta: float | None, gradient: bool = True):
        """Weighted losses by task, divided by the nodes (circuits) of the whole batch, and their gradients by parameter."""
        z, clock, emb, (x, a, h, arrival, up, top, down, context, tapes) = self.forward(b, beta)
        p, s, target, half = self.p, self.scale, self.targets(b), h.shape[1]
        losses, gz = {}, {}
        for t in self.tasks:
            each, slope = _loss(HEADS[t][1], z[t], target[t], s["positive"].get(t, 1.0))
            losses[t], gz[t] = each.sum() / nodes, slope * weights[t] / nodes
        off = clock - (b.clock - s["clock_mean"]) / s["clock_std"]
        losses["clock_period"] = (off**2).sum() / circuits
        if not gradient:
            return losses, {}
        if "slack" in gz and {"arrival_time", "required_time"} <= set(self.tasks):
            std = dict(zip(NS, s["y_std"]))
            gz["required_time"] = gz["required_time"] + gz["slack"] * std["required_time"] / std["slack"]
            gz["arrival_time"] = gz["arrival_time"] - gz["slack"] * std["arrival_time"] / std["slack"]
        g, g_emb = {}, np.zeros_like(emb)
        for t in self.tasks:
            v, act, slope = tapes[t]
            inner = gz[t][:, None] * p[f"{t}.w2"] * slope
            g |= {f"{t}.w2": gz[t] @ act, f"{t}.b2": gz[t].sum(keepdims=True), f"{t}.w1": inner.T @ v, f"{t}.b1": inner.sum(0)}
            part = HEADS[t][0]
            g_emb[:, slice(None) if part is None else slice(part * half, (part + 1) * half)] += inner @ p[f"{t}.w1"]
        summed = np.add.reduceat(g_emb, b.first)
        g |= {"raw.w": g_emb.T @ x, "raw.b": g_emb.sum(0), "context.w": summed.T @ context, "context.b": g_emb.sum(0)}

        def back(way, gu, tapes):
            g[f"{way}.w"], g[f"{way}.b"] = np.zeros((half, b.e.shape[1])), np.zeros(half)
            while tapes:
                gu, sent = b.ways[way].back(gu, tapes.pop())
                for place, s in sent:
                    g[f"{way}.w"] += s.T @ b.e[place]
                    g[f"{way}.b"] += s.sum(0)
            return gu

        start = -back("backward", -g_emb[:, half:], down)
        g_seed = np.add.reduceat(start, b.first)
        g_clock = 2 * off * weights.get("clock_period", 0.0) / circuits
        g |= {"seed.w": g_seed.T @ top, "seed.b": g_seed.sum(0), "clock.w": g_clock @ top, "clock.b": g_clock.sum(keepdims=True)}
        g_top = g_seed @ p["seed.w"] + g_clock[:, None] * p["clock.w"]
        g_arrival = g_emb[:, :half].copy()
        is_top = arrival == top[b.of]
        is_top &= (np.cumsum(is_top, 0) - (np.cumsum(is_top, 0) - is_top)[b.first][b.of]) == 1  # the first of equal ones
        g_arrival += is_top * g_top[b.of]
        g_h = back("forward", g_arrival, up) + start
        g_a = g_h * np.where(a > 0, 1.0, np.exp(np.minimum(a, 0)))
        g |= {"in.w": g_a.T @ x, "in.b": g_a.sum(0)}
        return losses, g

    def predict(self, b: Batch) -> dict[str, np.ndarray]:
        """Head values in their own units: ns, or probabilities."""
        z = self.forward(b)[0]
        mean, std = (dict(zip(NS, self.scale[k])) for k in ("y_mean", "y_std"))
        return {t: z[t] * std[t] + mean[t] if t in NS else 1 / (1 + np.exp(-np.clip(z[t], -60, 60))) for t in self.tasks}
