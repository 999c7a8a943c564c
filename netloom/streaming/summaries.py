"""Slack summaries of circuits that are kept up to date while reports arrive, and the same over a whole table.

A report (circuit_id, node, ts, report_id, slack) says what a node's slack is; of a node's reports the one with the latest
(ts, report_id) counts, in whatever order they come. The stream holds each circuit's latest reports as state (as many as the
circuit has nodes), sends a new summary whenever one changes, and another one, marked idle, when the watermark is `idle_ms`
beyond its last report. Reports behind the watermark are dropped. Null keys, times and slacks are left out.

The sink merges each micro-batch into the table of latest summaries and writes it as a version under the batch's number, so a
batch that runs again after a restart writes the same version again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import _children
from ..sources import stores

SUMMARY = "circuit_id long, n long, n_violations long, worst_slack double, worst_node long, idle boolean"
STATE = "nodes array<long>, times array<long>, ids array<long>, slacks array<double>"


def _whole(reports: DataFrame) -> DataFrame:
    return reports.where("circuit_id IS NOT NULL AND node IS NOT NULL AND ts IS NOT NULL AND slack IS NOT NULL")


def batch_summaries(reports: DataFrame) -> DataFrame:
    """(circuit_id, n, n_violations, worst_slack, worst_node) of the latest reports; the worst node is the least one with that slack."""
    last = _whole(reports).groupBy("circuit_id", "node").agg(F.max_by("slack", F.struct("ts", "report_id")).alias("slack"))
    worst = F.min(F.struct("slack", "node"))
    return last.groupBy("circuit_id").agg(F.count("*").alias("n"), F.sum((F.col("slack") <= 0).cast("long")).alias("n_violations"), worst.alias("w")).select("circuit_id", "n", "n_violations", F.col("w.slack").alias("worst_slack"), F.col("w.node").alias("worst_node"))


def stream_summaries(reports: DataFrame, delay: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The stream of SUMMARY rows of a stream of reports."""

    def update(key, parts, state: GroupState):
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        if not state.hasTimedOut:
            for part in parts:
                for node, ts, report, slack in zip(part["node"].tolist(), part["ts"].astype("int64").tolist(), part["report_id"].tolist(), part["slack"].tolist()):
                    if node not in held or held[node][:2] < (ts, report):
                        held[node] = (ts, report, slack)
            nodes = sorted(held)
            times, ids, slacks = (list(x) for x in zip(*(held[k] for k in nodes)))
            state.update((nodes, times, ids, slacks))
            unit = 1_000_000 if part["ts"].dtype.str.endswith("[ns]") else 1_000
            state.setTimeoutTimestamp(max(max(times) // unit + idle_ms, state.getCurrentWatermarkMs() + 1))
        worst = min((v[2], k) for k, v in held.items())
        yield pd.DataFrame({"circuit_id": [key[0]], "n": [len(held)], "n_violations": [sum(v[2] <= 0 for v in held.values())], "worst_slack": [worst[0]], "worst_node": [worst[1]], "idle": [state.hasTimedOut]})

    timed = _whole(reports).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("circuit_id").applyInPandasWithState(update, SUMMARY, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The last whole version of the table, or the last one before batch `below`; None if there is none."""
    done = [int(n.split("-")[1]) for n in _children(spark, path) if n.startswith("version-") and "_SUCCESS" in _children(spark, f"{path}/{n}")]
    done = [n for n in done if below is None or n < below]
    return spark.read.schema(SUMMARY).parquet(f"{path}/version-{max(done):08d}") if done else None


def keep(summaries: DataFrame, path: str, checkpoint: str):
    """Starts the stream, which takes what has arrived and ends; the table is at latest(path)."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("circuit_id").agg(F.max(F.struct("n", "n_violations", "worst_slack", "worst_node", "idle")).alias("x")).select("circuit_id", "x.*")
        old = latest(spark, path, number)
        merged = newest if old is None else stores.upsert(old, newest, ["circuit_id"])
        merged.write.mode("overwrite").parquet(f"{path}/version-{number:08d}")

    return summaries.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
