"""Head losses as column expressions and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bce(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large magnitudes."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log(1.0 + F.exp(-F.abs(z)))


def focal(z: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = 1.0 / (1.0 + F.exp(-z))
    pt = F.when(y == 1, p).otherwise(1.0 - p)
    return F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha)) * F.pow(1.0 - pt, F.lit(gamma)) * bce(z, y)


def huber(d: Column, delta: float = 2.0) -> Column:
    return F.when(F.abs(d) < delta, d * d / (2 * delta)).otherwise(F.abs(d) - delta / 2)


def losses(rows: DataFrame, cap: float = 20.0) -> DataFrame:
    """Means of BCE, BCE with the positive weight min(cap, negatives / positives), focal, squared error and Huber."""
    z, y = F.col("logit"), F.col("y")
    n, pos = F.count("*"), F.sum("y")
    weight = F.least(F.lit(cap), (n - pos) / F.greatest(pos, F.lit(1.0)))
    of_pos = F.sum(F.when(y == 1, bce(z, y)).otherwise(F.lit(0.0)))
    of_neg = F.sum(F.when(y == 1, F.lit(0.0)).otherwise(bce(z, y)))
    p = 1.0 / (1.0 + F.exp(-z))
    return rows.agg(F.round(F.avg(bce(z, y)), 9).alias("bce"), F.round((weight * of_pos + of_neg) / n, 9).alias("weighted_bce"), F.round(F.avg(focal(z, y)), 9).alias("focal"), F.round(F.avg((p - y) * (p - y)), 9).alias("mse"), F.round(F.avg(huber(z - y)), 9).alias("huber"))
