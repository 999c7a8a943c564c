"""Connected components of a link table, by the least reachable id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written

#: Edges that one task joins by itself, since rounds over so few rows would cost more than the rows.
EDGES = 250_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the edges and the least id that they reach from it."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every end of edges (a, b): the least id that links reach from v.

    Up to EDGES edges are joined in one task. Of more edges, each round takes the least label among a vertex and its
    neighbours and then the label of that label, so a path of length n is done in about log n rounds; labels are written
    as Parquet in the shared folder each round, which cuts the lineage. Both ways give the same labels. Only counts go to the
    driver. Null ends are dropped, loops and repeated edges do no harm, and no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(edges.distinct(), "edges")
    if edges.count() <= EDGES:

        def whole(batches):
            parts = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
            if parts:
                v, c = least_labels(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], ["v", "c"])

        return written(edges.coalesce(1).mapInArrow(whole, "v long, c long"), "labels")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        stepped = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        following = written(stepped.join(jump, "c").select("v", F.least("c", "up").alias("c"), (F.least("c", "up") < F.col("old")).alias("changed")), "labels")
        labels = following.select("v", "c")
        if following.where("changed").isEmpty():
            return labels
