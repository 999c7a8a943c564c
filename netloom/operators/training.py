"""What surrounds training: schedules, task weights, epochs, early stopping, drift between heads, size and name filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import losses

# Weights of tasks that the user does not weigh, and the ends of the temperature ramp.
TASK_WEIGHTS = {"slack": 3.0, "arrival_time": 1.0, "required_time": 1.0, "clock_period": 0.5}
BETA_START, BETA_END = 8.0, 1000.0
# What a circuit's name says of its topology, the first match counting.
NAME_TOPOLOGIES = [
    ("pipelined_datapath", ("bp_", "rocket", "ariane", "core", "fetch", "exec", "aes", "des", "jpeg", "fft", "dft", "idft", "fpu", "mult")),
    ("finite_state_machine", ("eth", "i2c", "spi", "uart", "vga", "tlb", "dma")),
    ("memory_array", ("ram", "rom", "mem", "cache")),
    ("clock_distribution", ("clk", "pll", "ckdiv")),
]
OTHER_TOPOLOGY = "combinational_logic"


def weighed(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, task, given) with a weight: the given one, else the default of the task's name, else an equal share of the
    tasks that share `by`."""
    shares = rows.groupBy(by).agg((1.0 / F.count("*")).alias("share"))
    default = F.lit(None).cast("double")
    for task, weight in TASK_WEIGHTS.items():
        default = F.when(F.col("task") == task, weight).otherwise(default)
    return rows.join(shares, by).select(by, "task", F.coalesce(F.col("given").cast("double"), default, "share").alias("weight"))


def task_weights(spark: SparkSession, tasks: list[str], given: dict[str, float] | None = None) -> DataFrame:
    """(task, weight): the given weight, else the default one, else an equal share."""
    rows = [(t, float((given or {}).get(t, TASK_WEIGHTS.get(t, 1.0 / len(tasks))))) for t in tasks]
    return spark.createDataFrame(rows, "task string, weight double")


def schedule(spark: SparkSession, epochs: int, warmup: int) -> DataFrame:
    """(epoch from 1, lr_factor, beta): linear warm-up from a hundredth, then a cosine to 0; a geometric temperature ramp."""
    return schedules(spark.createDataFrame([(epochs,)], "epochs long"), warmup).select("epoch", "lr_factor", "beta")


def schedules(runs: DataFrame, warmup: int) -> DataFrame:
    """runs with a row for each of their epochs: epoch, lr_factor, beta, as in schedule()."""
    rows = runs.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs").cast("long"))))
    e, n = F.col("epoch") - 1, F.col("epochs")
    rising = F.greatest(F.lit(0), F.least(F.lit(warmup), n - 1))
    rise = 0.01 + 0.99 * e / F.greatest(rising, F.lit(1))
    fall = 0.5 * (1.0 + F.cos(math.pi * (e - rising) / F.greatest(F.lit(1), n - rising)))
    share = F.when(n > 1, e / F.greatest(n - 1, F.lit(1))).otherwise(1.0)
    beta = F.exp(math.log(BETA_START) + share * (math.log(BETA_END) - math.log(BETA_START)))
    return rows.withColumns({"lr_factor": F.round(F.when(e < rising, rise).otherwise(fall), 9), "beta": F.round(beta, 6)})


def epoch_losses(batches: DataFrame) -> DataFrame:
    """(epoch, n, loss): mean of a column loss over the batches of each epoch."""
    return batches.groupBy("epoch").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def best_epoch(epochs: DataFrame, patience: int) -> DataFrame:
    """(best_epoch, best_loss, stopped_at): training ends after `patience` epochs without a lower loss; null if it never does."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each epoch
    until = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = epochs.withColumn("low", F.min("loss").over(before)).withColumn("better", F.col("low").isNull() | (F.col("loss") < F.col("low")))
    rows = rows.withColumn("last", F.max(F.when(F.col("better"), F.col("epoch"))).over(until))
    stop = F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch")))
    rows = rows.withColumn("stop", stop.over(Window.partitionBy()))
    run = rows.where(F.col("better") & (F.col("stop").isNull() | (F.col("epoch") <= F.col("stop"))))
    return run.agg(F.max("epoch").alias("best_epoch"), F.min("loss").alias("best_loss"), F.first("stop").alias("stopped_at"))


def composition_drift(rows: DataFrame) -> DataFrame:
    """How far each circuit's slack is from required minus arrival time: greatest and mean difference."""
    drift = F.abs(F.col("slack") - (F.col("required_time") - F.col("arrival_time")))
    return rows.groupBy("circuit_id").agg(F.round(F.max(drift), 9).alias("max_drift"), F.round(F.avg(drift), 9).alias("mean_drift"))


def multitask_losses(rows: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """Each circuit's Huber loss of the slack, squared arrival time, cross-entropy of the critical flag and their weighted sum."""
    weights = {t.task: t.weight for t in task_weights(rows.sparkSession, ["slack", "arrival_time", "critical_path"], given).collect()}  # a row for each task
    parts = {"slack": losses.huber(F.col("slack")), "arrival_time": F.col("arrival_time") * F.col("arrival_time"), "critical_path": losses.bce(-10.0 * F.col("slack"), F.col("critical"))}
    means = rows.groupBy("circuit_id").agg(*(F.avg(v).alias(k) for k, v in parts.items()))
    total = sum((weights[k] * F.col(k) for k in list(parts)[1:]), weights["slack"] * F.col("slack"))
    return means.select("circuit_id", *(F.round(k, 9).alias(k) for k in parts), F.round(total, 9).alias("loss"))


def topology_of(name: Column) -> Column:
    low, out = F.lower(name), None
    for topology, words in NAME_TOPOLOGIES:
        hit = low.rlike("|".join(words))
        out = F.when(hit, topology) if out is None else out.when(hit, topology)
    return out.otherwise(OTHER_TOPOLOGY)


def gain_share(gain: Column) -> Column:
    """A gain given as a percentage (1 and above) or a share, as a share."""
    return F.when(gain >= 1, gain / 100.0).otherwise(gain)


def max_positive(values: Column) -> Column:
    """Aggregate: the greatest positive value, 1 where there is none."""
    return F.coalesce(F.max(F.when(values > 0, values)), F.lit(1.0))


def half(vector: str, second: bool) -> Column:
    """The first or second half of an array, as a directional head reads it."""
    n = F.floor(F.size(vector) / 2).cast("int")
    return F.slice(vector, n + 1 if second else F.lit(1), n)


def check_targets(rows: DataFrame, tasks: list[str]) -> DataFrame:
    """rows, if they have a column for each task; otherwise an error that names those that lack."""
    missing = [t for t in tasks if t not in rows.columns]
    if missing:
        raise ValueError(f"no label column for: {', '.join(missing)}")
    return rows
