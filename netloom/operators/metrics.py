"""Regression and ranking metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def regression(rows: DataFrame, *by: str) -> DataFrame:
    """n, MSE, MAE, R2 and Pearson of pred against target; R2 is null if the target does not vary."""
    d = F.col("pred") - F.col("target")
    total = F.sum(F.col("target") * F.col("target")) - F.sum("target") * F.sum("target") / F.count("*")
    r2 = F.when(total > 0, 1.0 - F.sum(d * d) / total)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(d * d), 2).alias("mse"), F.round(F.avg(F.abs(d)), 4).alias("mae"), F.round(r2, 6).alias("r2"), F.round(F.corr("pred", "target"), 6).alias("pearson"))


def _steps(scored: DataFrame) -> DataFrame:
    """(score, tpr, fpr) from the highest score down; equal scores are one step.

    Rows are first summed for each distinct score. Running sums over the scores go through ranges of the score: each
    range is summed by itself and then shifted by what lies in higher ranges, so no task sees all scores.
    """
    each = scored.groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    ranged = each.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id())
    from ..sources.tables import checkpointed

    ranged = checkpointed(ranged)
    parts = ranged.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("n0"), F.sum("pp").over(whole).alias("pt"), F.sum("pn").over(whole).alias("nt"))
    down = Window.partitionBy("part").orderBy(F.desc("score"))
    run = ranged.join(F.broadcast(parts), "part")  # a row for each range
    return run.select("score", "p", "n", ((F.col("p0") + F.sum("p").over(down)) / F.col("pt")).alias("tpr"), ((F.col("n0") + F.sum("n").over(down)) / F.col("nt")).alias("fpr"), "pt", "nt")


def roc(scored: DataFrame) -> DataFrame:
    return _steps(scored).select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def auc(scored: DataFrame) -> DataFrame:
    """Area by trapezoids over tied steps, which is the tie-averaged rank statistic."""
    area = F.sum((F.col("n") / F.col("nt")) * (F.col("tpr") - F.col("p") / F.col("pt") / 2.0))
    return _steps(scored).agg(F.round(area, 9).alias("auc"), F.sum(F.col("p") + F.col("n")).alias("n"))


def youden(scored: DataFrame) -> DataFrame:
    """The threshold with the greatest TPR - FPR; ties go to the higher score."""
    best = _steps(scored).agg(F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("j"), "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.round("b.j", 9).alias("j"))


def classification(scored: DataFrame) -> DataFrame:
    """Confusion counts and rates at the Youden threshold."""
    t = F.broadcast(youden(scored).select("threshold"))  # one row
    hit = F.col("score") >= F.col("threshold")
    cells = {"tp": hit & (F.col("y") == 1), "fp": hit & (F.col("y") == 0), "fn": ~hit & (F.col("y") == 1), "tn": ~hit & (F.col("y") == 0)}
    c = scored.join(t).agg(*(F.sum(x.cast("long")).alias(k) for k, x in cells.items()))
    tp, fp, fn, tn = (F.col(k) for k in cells)
    return c.select("tp", "fp", "fn", "tn", F.round((tp + tn) / (tp + fp + fn + tn), 9).alias("accuracy"), F.round(tp / F.nullif(tp + fp, F.lit(0)), 9).alias("precision"), F.round(tp / F.nullif(tp + fn, F.lit(0)), 9).alias("recall"), F.round(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), 9).alias("f1"))
