"""Learned heads on node features with pyspark.ml: squared-error regression and weighted logistic classification."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import checkpointed
from . import metrics

FEATURES = ["is_pi", "is_po", "delay_f", "cap_f", "res_f", "clock_f", "depth_f"]


def _split(rows: DataFrame, features: list[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """Train and held-out circuits by a hash of the circuit; the rows are stored, since every fit and figure reads them."""
    v = VectorAssembler(inputCols=features, outputCol="f").transform(checkpointed(rows))
    held = F.pmod(F.xxhash64("circuit_id"), F.lit(10)) < 3
    return v.where(~held), v.where(held)


def regression_head(rows: DataFrame) -> DataFrame:
    train, held = _split(rows)
    model = LinearRegression(featuresCol="f", labelCol="y", predictionCol="pred", regParam=1e-6).fit(train)
    return metrics.regression(model.transform(held).withColumnRenamed("y", "target"))


def classifier_head(rows: DataFrame, cap: float = 20.0) -> DataFrame:
    """Positives weigh min(cap, negatives / positives); the result is judged at the Youden threshold."""
    train, held = _split(rows)
    pos = train.agg(F.least(F.lit(cap), F.sum(1 - F.col("y")) / F.greatest(F.sum("y"), F.lit(1.0))).alias("w"))
    train = train.join(F.broadcast(pos)).withColumn("weight", F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(1.0)))  # one row
    model = LogisticRegression(featuresCol="f", labelCol="y", weightCol="weight", probabilityCol="p", regParam=1e-6).fit(train)
    from pyspark.ml.functions import vector_to_array

    return metrics.classification(checkpointed(model.transform(held).select(F.round(vector_to_array("p")[1], 9).alias("score"), F.col("y").cast("long").alias("y"))))


def _regressed(train: DataFrame, held: DataFrame, target: str) -> DataFrame:
    """held with pred_<target>."""
    return LinearRegression(featuresCol="f", labelCol=target, predictionCol=f"pred_{target}", regParam=1e-6).fit(train).transform(held)


def _judged(rows: DataFrame, head: str, pred, target: str) -> DataFrame:
    figures = metrics.regression(rows.select(pred.alias("pred"), F.col(target).alias("target")))
    return figures.select(F.lit(head).alias("head"), F.lit("r2").alias("measure"), "n", F.col("r2").alias("value"))


def regression_heads(rows: DataFrame, targets: list[str], features: list[str] = FEATURES) -> DataFrame:
    """(head, measure, n, value): R2 on held-out circuits of a head for each target.

    The slack is not fitted but composed, required less arrival time, if both are among the targets.
    """
    train, held = _split(rows, features)
    composed = {"slack", "arrival_time", "required_time"} <= set(targets)
    out = None
    for target in targets:
        if not (composed and target == "slack"):
            held = _regressed(train, held, target)
    for target in targets:
        pred = F.col("pred_required_time") - F.col("pred_arrival_time") if composed and target == "slack" else F.col(f"pred_{target}")
        one = _judged(held, target, pred, target)
        out = one if out is None else out.unionByName(one)
    return out


def flag_heads(rows: DataFrame, targets: list[str], features: list[str] = FEATURES) -> DataFrame:
    """(head, measure, n, value): area under the ROC curve on held-out circuits of a classifier for each 0/1 target."""
    from pyspark.ml.functions import vector_to_array

    train, held = _split(rows, features)
    out = None
    for target in targets:
        model = LogisticRegression(featuresCol="f", labelCol=target, probabilityCol="p", regParam=1e-6).fit(train)
        scored = model.transform(held).select(F.round(vector_to_array("p")[1], 9).alias("score"), F.col(target).cast("long").alias("y"))
        one = metrics.auc(scored).select(F.lit(target).alias("head"), F.lit("auc").alias("measure"), "n", F.col("auc").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
