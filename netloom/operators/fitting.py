"""Training, storing and using the timing network: circuits are rows, gradients are summed by Spark.

`graphs` has a row for each circuit with its node vectors, edges and targets as flat arrays. A step sends the parameters
to all tasks; each task adds up the gradients of its circuits, and Spark sums them by parameter, so what comes to the
driver is as long as the model and not as the data. Circuits of more than `most` nodes are not training units (they are
cut into cones first, see cones.py). Rows are dealt so that a partition has some NODES nodes.
"""

from __future__ import annotations

import functools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import stores
from ..sources.tables import checkpointed
from . import timing, training
from .network import HEADS, NS, POSITIVE_CAP, Batch, Network, distance, initial, shapes

#: Nodes of a stored file of circuits, and of the circuits that one call of the network takes together, whose values for each sweep are held.
NODES, BATCH = 50_000, 20_000
GRAPH = "circuit_id long, n int, x array<float>, drv array<int>, snk array<int>, e array<float>, y array<float>, clock double"


def _ends(batches):
    """Both ends of each edge as their places among the circuit's nodes; an end that is no node of it is null."""
    for batch in batches:
        column = {c: batch.column(c) for c in ("idx", "drv", "snk")}
        row, flat = ({c: np.repeat(np.arange(len(v)), pa.compute.list_value_length(v).to_numpy()) for c, v in column.items()}, {c: v.flatten().to_numpy() for c, v in column.items()})
        numbers, base = timing._numbered(row["idx"], flat["idx"]), np.searchsorted(row["idx"], np.arange(batch.num_rows))
        for c in ("drv", "snk"):
            at, known = timing._place(numbers, row[c], flat[c])
            places = pa.array((at - base[row[c]]).astype(np.int32), mask=~known)
            offsets = np.r_[0, np.cumsum(pa.compute.list_value_length(column[c]).to_numpy())]
            batch = batch.set_column(batch.schema.get_field_index(c), c, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places))
        yield batch.select([f.split()[0] for f in GRAPH.split(", ")])


def graphs(nodes: DataFrame, edges: DataFrame, features: list[str], edge_features: list[str], tasks: list[str], least: int = 1, most: int | None = 6000) -> DataFrame:
    """One row for each circuit of `least` to `most` nodes, or of any number. nodes: circuit_id, idx (any distinct numbers), clock, the
    features and the targets; edges: circuit_id, drv, snk and the edge features. Nulls count as 0."""
    training.check_targets(nodes, tasks)
    f = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("float")
    sizes = nodes.groupBy("circuit_id").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= most if most is not None else F.lit(True))).select("circuit_id")
    one = nodes.join(sizes, "circuit_id", "left_semi").groupBy("circuit_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.array(*map(f, features)).alias("x"), F.array(*map(f, tasks)).alias("y")))).alias("v"), F.first("clock").alias("clock"))
    arcs = edges.join(sizes, "circuit_id", "left_semi").groupBy("circuit_id").agg(F.collect_list(F.struct("drv", "snk", F.array(*map(f, edge_features)).alias("e"))).alias("a"))
    rows = one.join(arcs, "circuit_id", "left")
    end = lambda c: F.coalesce(F.col(c).cast("array<bigint>"), F.array().cast("array<bigint>")).alias(c.split(".")[1])
    flat = lambda c, name: F.coalesce(F.flatten(c), F.array().cast("array<float>")).alias(name)
    rows = rows.select("circuit_id", F.size("v").alias("n"), end("v.idx"), flat("v.x", "x"), end("a.drv"), end("a.snk"), flat("a.e", "e"), flat("v.y", "y"), F.col("clock").cast("double").alias("clock"))
    total = nodes.count()
    return checkpointed(rows.mapInArrow(_ends, GRAPH).repartition(max(1, total // NODES, min(8, total // 5000)), "circuit_id"))


def _batches(batches, features, edge, tasks):
    """Circuits of a partition in runs of some BATCH nodes."""
    for batch in batches:
        cut = np.flatnonzero(np.diff(np.cumsum(batch.column("n").to_numpy()) // BATCH)) + 1 if batch.num_rows else []
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a), Batch(batch.slice(a, b - a), features, edge, tasks)


class Model:
    """A network and what its inputs are called."""

    def __init__(self, network: Network, features: list[str], edge_features: list[str], hidden: int):
        self.network, self.features, self.edge_features, self.hidden = network, features, edge_features, hidden
        self.sizes = (len(features), len(edge_features), len(network.tasks))

    def flat(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.ravel(values[k]) for k in self.network.p])

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([v.size for v in self.network.p.values()])[:-1]
        return {k: part.reshape(v.shape) for (k, v), part in zip(self.network.p.items(), np.split(flat, cuts))}

    def sums(self, rows: DataFrame, weights: dict[str, float], nodes: int, circuits: int, beta: float | None, gradient: bool = True) -> tuple[dict[str, float], np.ndarray | None]:
        """Losses by task and the gradient over all rows, summed by Spark."""
        return self._sums([(rows, nodes, circuits, beta, gradient)], weights)[0]

    def _sums(self, parts: list[tuple[DataFrame, int, int, float | None, bool]], weights: dict[str, float]) -> list[tuple[dict[str, float], np.ndarray | None]]:
        """sums() of several (rows, nodes, circuits, beta, gradient), in one job."""
        context = parts[0][0].sparkSession.sparkContext
        shared, names = context.broadcast(self.network), [*self.network.tasks, "clock_period"]
        sizes, flat, length = self.sizes, self.flat, len(names) + self.flat(self.network.p).size

        def run(part: int, nodes: int, circuits: int, beta: float | None, gradient: bool):
            def add(batches):
                network, total = shared.value, 0.0
                for _, batch in _batches(batches, *sizes):
                    losses, g = network.loss(batch, weights, nodes, circuits, beta, gradient)
                    total = total + np.concatenate([[losses[k] for k in names], flat(g) if gradient else []])
                if not np.isscalar(total):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32) + part * length), pa.array(total)], ["k", "value"])

            return add

        added = [rows.mapInArrow(run(part, *rest), "k int, value double") for part, (rows, *rest) in enumerate(parts)]
        found = dict(functools.reduce(DataFrame.unionByName, added).groupBy("k").agg(F.sum("value")).collect())  # as many as parameters
        shared.destroy()
        out = []
        for part, (*_, gradient) in enumerate(parts):
            values = np.array([found.get(part * length + k, 0.0) for k in range(length if gradient else len(names))])
            out.append((dict(zip(names, values)), values[len(names) :] if gradient else None))
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """(circuit_id, idx, pred_<task>...) of graphs; idx is the place among the circuit's nodes in order."""
        network, sizes, tasks = self.network, self.sizes, self.network.tasks

        def run(parts):
            for part, batch in _batches(parts, *sizes):
                ids = np.repeat(part.column("circuit_id").to_numpy(), batch.n)
                found = network.predict(batch)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(len(ids)) - batch.first[batch.of]), *(pa.array(found[t]) for t in tasks)], ["circuit_id", "idx", *(f"pred_{t}" for t in tasks)])

        return rows.mapInArrow(run, "circuit_id long, idx long, " + ", ".join(f"pred_{t} double" for t in tasks))

    def flagged(self, rows: DataFrame, threshold: float = 0.85) -> DataFrame:
        """predict() with a 0/1 flag for each probability that is above the threshold."""
        found = self.predict(rows)
        return found.withColumns({f"flag_{t}": (F.col(f"pred_{t}") > threshold).cast("int") for t in self.network.tasks if t not in NS})

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and scales as one file of JSON lines."""
        n = self.network
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in n.scale.items()}
        facts = json.dumps({"tasks": n.tasks, "sweeps": n.sweeps, "features": self.features, "edge_features": self.edge_features, "hidden": self.hidden, "scale": plain})
        rows = [(k, v.ravel().tolist(), None) for k, v in n.p.items()] + [("", None, facts)]
        stores.save_json(spark.createDataFrame(rows, "name string, value array<double>, facts string"), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = {r.name: r for r in stores.load_json(spark, path, "name string, value array<double>, facts string").collect()}
        facts = json.loads(rows.pop("").facts)
        wanted = shapes(len(facts["features"]), len(facts["edge_features"]), facts["hidden"], facts["tasks"])
        scale = {k: np.array(v) if isinstance(v, list) else v for k, v in facts["scale"].items()}
        return Model(Network({k: np.array(rows[k].value).reshape(shape) for k, shape in wanted.items()}, facts["tasks"], facts["sweeps"], scale), facts["features"], facts["edge_features"], facts["hidden"])


def scales(nodes: DataFrame, features: list[str], tasks: list[str]) -> dict:
    """Mean and deviation of features, of the targets in ns and of the clock, and each flag's positive weight."""
    stat = lambda c: (F.avg(c), F.stddev_pop(c))
    ns = [t for t in NS if t in nodes.columns]
    flags = [t for t in tasks if HEADS[t][1] == "bce"]
    row = nodes.agg(*(x for c in [*features, *ns] for x in stat(F.col(c).cast("double"))), *(F.avg(F.col(t).cast("double")) for t in flags)).first()
    values = [0.0 if v is None else v for v in row]
    mean, std = np.array(values[0 : 2 * len(features) : 2]), np.array(values[1 : 2 * len(features) : 2])
    rest = values[2 * len(features) :]
    of = {t: (rest[2 * k], max(rest[2 * k + 1], 1e-3)) for k, t in enumerate(ns)}
    clock = nodes.groupBy("circuit_id").agg(F.first("clock").alias("c")).agg(*stat("c")).first()
    share = dict(zip(flags, rest[2 * len(ns) :]))
    return {
        "x_mean": mean, "x_std": np.where(std > 1e-9, std, 1.0), "y_mean": np.array([of.get(t, (0.0, 1.0))[0] for t in NS]), "y_std": np.array([of.get(t, (0.0, 1.0))[1] for t in NS]),
        "clock_mean": clock[0] or 0.0, "clock_std": max(clock[1] or 0.0, 1e-3), "positive": {t: min(POSITIVE_CAP, (1 - v) / max(v, 1e-9)) for t, v in share.items()},
    }


class AdamW:
    """Steps with clipped gradients, decoupled weight decay and a learning rate for each parameter."""

    def __init__(self, rates: np.ndarray, decay: float = 1e-4, clip: float = 1.0):
        self.rates, self.decay, self.clip, self.t = rates, decay, clip, 0
        self.m = self.v = np.zeros_like(rates)

    def step(self, values: np.ndarray, g: np.ndarray, factor: float) -> np.ndarray:
        g = g * min(1.0, self.clip / max(np.linalg.norm(g), 1e-12))
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        rate = self.rates * factor
        move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return values * (1 - rate * self.decay) - rate * move


def fit(train: DataFrame, validation: DataFrame, nodes: DataFrame, features: list[str], edge_features: list[str], tasks: list[str], hidden: int = 16, sweeps: int = 8, epochs: int = 100, patience: int = 40, warmup: int = 5, rate: float = 1e-3, layer_decay: float = 1.0, batches: int = 1, weights: dict[str, float] | None = None, seed: int = 0, path: str | None = None) -> tuple[Model, list[dict]]:
    """The model with the least validation loss, and the history: epoch, lr_factor, train and validation loss.

    train and validation are graphs(), nodes the training nodes for the scales. Each epoch takes `batches` steps, each over
    the circuits of one remainder of a hash that changes with the epoch. The rate of a layer is rate * layer_decay ** (layers
    between it and the heads). With `path`, each better model is stored there. Training ends after `patience` epochs without
    a better one. A step's job also gives the validation loss of the model before it.
    """
    spark = train.sparkSession
    weights = {r.task: r.weight for r in training.task_weights(spark, [*tasks, "clock_period"], weights).collect()}
    network = Network(initial(len(features), len(edge_features), hidden, tasks, seed), tasks, sweeps, scales(nodes, features, tasks))
    model = Model(network, features, edge_features, hidden)
    rates = np.concatenate([np.full(v.size, rate * layer_decay ** distance(k)) for k, v in network.p.items()])
    steps, history, best, best_at = AdamW(rates), [], math.inf, 0
    size = lambda df: (r := df.agg(F.sum("n"), F.count("*")).first())[0] and (r[0], r[1]) or (1, 1)
    whole = size(validation)
    values = kept = model.flat(network.p)
    total = lambda losses: sum(weights[k] * v for k, v in losses.items())
    counted = size(train)
    judge, wait = (validation, *whole, None, False), []  # the epoch whose model is not judged yet

    def better(found: float) -> bool:
        """Whether training goes on after the waiting epoch, whose model has this validation loss."""
        nonlocal best, best_at, kept
        epoch, factor, lost = wait.pop()
        history.append({"epoch": epoch, "lr_factor": factor, "train": float(lost), "validation": float(found)})
        if found < best:
            best, best_at, kept = found, epoch, values
            if path:
                model.save(spark, path)
        return best_at == epoch or epoch - best_at < patience

    for plan in training.schedule(spark, epochs, warmup).orderBy("epoch").collect():  # a row for each epoch
        lost = 0.0
        for k in range(batches):
            some = train if batches == 1 else train.where(F.pmod(F.xxhash64("circuit_id", F.lit(plan.epoch)), F.lit(batches)) == k)
            (losses, g), *judged = model._sums([(some, *(counted if batches == 1 else size(some)), plan.beta, True), *([judge] if wait else [])], weights)
            if judged and not better(total(judged[0][0])):
                break
            values = steps.step(values, g, plan.lr_factor)
            network.p = model.named(values)
            lost += total(losses) / batches
        else:
            wait.append((plan.epoch, plan.lr_factor, lost))
            continue
        break
    if wait:
        better(total(model._sums([judge], weights)[0][0]))
    network.p = model.named(kept)
    return model, history
