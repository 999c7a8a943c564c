"""Synthetic digital circuits: by integer hashes of a seed, or drawn at random with a preference for low fan-out.

Both give the same circuits on every run and cluster.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import checkpointed

INPUTS, OUTPUTS, REACH = 4, 2, 6


def digital(seeds: DataFrame, gates: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a circuit for each seed (one column, seed): 4 inputs, gates of one to three pins, 2 outputs.

    A gate's pins are driven by nodes at most REACH before it, so every circuit is acyclic; the spread of the hash keeps
    fan-outs low. Outputs are driven by the last gates.
    """
    n = F.lit(INPUTS + OUTPUTS + gates) + F.col("seed") % 5
    rows = seeds.select(F.col("seed").cast("long").alias("circuit_id"), n.cast("long").alias("n"), F.col("seed").cast("long").alias("seed"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    role = F.when(F.col("idx") < INPUTS, "PI").when(F.col("idx") >= F.col("n") - OUTPUTS, "PO").otherwise("GATE")
    nodes = rows.withColumn("role", role).withColumn("cell_idx", F.when(F.col("role") == "GATE", (F.col("seed") * 31 + F.col("idx") * 7) % 19))
    pins = nodes.where("role = 'GATE'").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("seed") + F.col("idx")) % 3)))
    reach = F.least("idx", F.lit(REACH).cast("long"))
    edges = pins.select("circuit_id", (F.col("idx") - 1 - (F.col("seed") * 13 + F.col("idx") * 5 + F.col("p") * 3) % reach).alias("drv"), F.col("idx").alias("snk"))
    outputs = nodes.where("role = 'PO'").select("circuit_id", (F.col("idx") - OUTPUTS - F.col("seed") % 2).alias("drv"), F.col("idx").alias("snk"))
    return nodes.select("circuit_id", "idx", "n", "role", "cell_idx"), edges.unionByName(outputs).distinct()


class Fenwick:
    """Integer weights in places 0, 1, ...; the place of a running total and a change of weight take about log n steps."""

    def __init__(self, size: int):
        self.size, self.tree, self.weight, self.total = size, [0] * (size + 1), [0] * size, 0
        self.top = 1 << max(0, size.bit_length() - 1)

    def put(self, at: int, weight: int) -> None:
        change, self.weight[at] = weight - self.weight[at], weight
        self.total += change
        k = at + 1
        while k <= self.size:
            self.tree[k] += change
            k += k & -k

    def find(self, target: int) -> int:
        """The first place up to which the weights add up to more than target."""
        at, step = 0, self.top
        while step:
            if at + step <= self.size and self.tree[at + step] <= target:
                at += step
                target -= self.tree[at]
            step >>= 1
        return at


#: Tenths of a weight: a signal weighs max(0.1, most - its fan-out).
TENTHS = 10


def wire_circuit(seed: int, inputs: int, gates: int, outputs: int, most: int, pins: list[int]) -> tuple[list[int], list[list[int]]]:
    """(cell of each gate, drivers of each gate and output) of one circuit; nodes are numbered inputs, gates, outputs.

    Each gate draws its drivers among the nodes before it without replacement, signals of low fan-out first by weight; with
    fewer signals than pins it draws with replacement. Outputs take different gates among the last, as long as there are any.
    """
    rng = random.Random(f"{seed} {inputs} {gates} {outputs}")
    live, fanout = Fenwick(inputs + gates), [0] * (inputs + gates)
    weight = lambda k: max(1, TENTHS * (most - fanout[k]))
    for k in range(inputs):
        live.put(k, weight(k))
    cells, drivers = [], []
    for g in range(inputs, inputs + gates):
        cells.append(rng.randrange(len(pins)))
        n = pins[cells[-1]]
        if g < n:
            chosen = [rng.randrange(g) for _ in range(n)] if g else []
        else:
            chosen = []
            for _ in range(n):
                chosen.append(live.find(rng.randrange(live.total)))
                live.put(chosen[-1], 0)
        for k in chosen:
            fanout[k] += 1
        for k in {*chosen, g}:
            live.put(k, weight(k))
        drivers.append(chosen)
    late = list(range(inputs + max(0, gates - 3 * outputs), inputs + gates))
    ends = rng.sample(late, min(outputs, len(late)))
    while gates and len(ends) < outputs:
        ends.append(inputs + rng.randrange(gates))
    return cells, drivers + [[k] for k in ends]


def random_digital(seeds: DataFrame, allowed: list[str] | None = None, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a random circuit for each row of seeds (seed, inputs, gates, outputs); a seed is a task's row.

    nodes: circuit_id (the seed), idx, role, node_type; edges: circuit_id, drv, snk with a pin number, so that a gate that
    has one driver twice keeps both. `allowed` names the cells that may be drawn, `most` is the fan-out from which a signal
    weighs least.
    """
    from ..functions.library import CELLS

    cells = [(c[0], c[5]) for c in CELLS if allowed is None or c[0] in allowed]
    if not cells:
        raise ValueError("no such cells")
    names, pins = [c[0] for c in cells], [c[1] for c in cells]

    def run(batches):
        for rows in batches:
            out = []
            for seed, inputs, gates, outputs in rows[["seed", "inputs", "gates", "outputs"]].itertuples(index=False):
                made, drivers = wire_circuit(seed, inputs, gates, outputs, most, pins)
                types = ["PI"] * inputs + [names[c] for c in made] + ["PO"] * (len(drivers) - gates)
                roles = ["PI"] * inputs + ["GATE"] * gates + ["PO"] * (len(drivers) - gates)
                out.append(pd.DataFrame({"circuit_id": seed, "idx": range(len(types)), "role": roles, "node_type": types, "drivers": [[]] * inputs + drivers}))
            if out:
                yield pd.concat(out)

    made = checkpointed(seeds.select(F.col("seed").cast("long").alias("seed"), *(F.col(c).cast("long").alias(c) for c in ("inputs", "gates", "outputs"))).mapInPandas(run, "circuit_id long, idx long, role string, node_type string, drivers array<long>"))
    edges = made.select("circuit_id", F.posexplode("drivers").alias("pin", "drv"), F.col("idx").alias("snk"))
    return made.drop("drivers"), edges.select("circuit_id", "drv", "snk", "pin")
