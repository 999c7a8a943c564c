"""Summaries of circuits and data sets, target statistics, splits and metadata filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def circuit_summary(slacks: DataFrame, labels: DataFrame) -> DataFrame:
    """What is stored with a circuit's embedding; num_gates is its number of nodes."""
    both = slacks.join(labels.select("circuit_id", "idx", "congestion"), ["circuit_id", "idx"])
    return both.groupBy("circuit_id").agg(F.count("*").alias("num_gates"), F.max("congestion").alias("max_congestion"), F.sum(F.col("is_critical").cast("long")).alias("critical_path_length"), F.round(F.avg("slack"), 9).alias("avg_slack"))


def dataset_summary(summaries: DataFrame, source: Column) -> DataFrame:
    """One row over all circuits; source says which circuit a row was cut out of."""
    rate = F.col("critical_path_length") / F.col("num_gates")
    return summaries.agg(F.count("*").alias("num_graphs"), F.countDistinct(source).alias("num_sources"), F.min("num_gates").alias("min_nodes"), F.max("num_gates").alias("max_nodes"), F.round(F.avg("num_gates"), 9).alias("mean_nodes"), F.sum("num_gates").alias("total_nodes"), F.round(F.avg(rate), 9).alias("mean_critical_rate"))


def target_stats(slacks: DataFrame) -> DataFrame:
    """Mean and population deviation (at least 1e-3) of slack, arrival, required time and clock."""
    out = []
    for column, name in (("slack", "slack"), ("at", "at"), ("required", "rt"), ("clock", "clock")):
        out += [F.round(F.coalesce(F.avg(column), F.lit(0.0)), 9).alias(f"{name}_mean"), F.round(F.coalesce(F.greatest(F.stddev_pop(column), F.lit(1e-3)), F.lit(1.0)), 9).alias(f"{name}_std")]
    return slacks.agg(*out)


def source_base(name) -> Column:
    return F.split(name, "_")[0]


def split_by_source(circuits: DataFrame, part: float = 0.15) -> DataFrame:
    """All circuits of one source in the same split; sources in the order of a hash of their name.

    Only the distinct sources are ranked, so the ranked rows are few even for many circuits.
    """
    keyed = circuits.withColumn("source_base", source_base("name"))
    keys = keyed.select("source_base").distinct()
    keys = keys.withColumn("r", F.row_number().over(Window.orderBy(F.md5("source_base")))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    size = F.greatest(F.lit(1.0), F.bround(F.col("n") * part, 0))
    keys = keys.select("source_base", F.when(F.col("r") <= size, "test").when(F.col("r") <= 2 * size, "val").otherwise("train").alias("split"))
    return keyed.join(keys, "source_base").select("circuit_id", "name", "source_base", "split")


def split_random(circuits: DataFrame) -> DataFrame:
    """70/15/15 by a hash of the name, without a sort."""
    h = F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long") % 100
    return circuits.select("circuit_id", "name", F.when(h < 70, "train").when(h < 85, "val").otherwise("test").alias("split"))


def predicate(specs: dict) -> Column:
    """{column: value} or {column: {min, max}} as one conjunction."""
    terms = []
    for column, spec in specs.items():
        if isinstance(spec, dict):
            terms += [F.col(column) >= spec["min"]] if spec.get("min") is not None else []
            terms += [F.col(column) <= spec["max"]] if spec.get("max") is not None else []
        else:
            terms.append(F.col(column) == spec)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def by_metadata(summaries: DataFrame, specs: dict, limit: int) -> DataFrame:
    return summaries.where(predicate(specs)).orderBy("circuit_id").limit(limit)
