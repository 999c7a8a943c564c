"""Mergeable sketches: distinct counts and quantiles stored for each source and rolled up without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bits of the distinct count's registers (a relative error of about 1.6 %) and size of the quantile sketch (1.3 % of rank).
REGISTERS, SIZE = 12, 200


def sketches(rows: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """(by..., n, items, values): a sketch of the distinct items and one of the values' distribution for each group; nulls
    are left out of the sketches and counted in n."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, REGISTERS).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("values"))


def rolled_up(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches merged to coarser groups; what comes out are sketches of the same kind."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values", SIZE).alias("values"))


def estimates(stored: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(by..., n, distinct, q<share in hundredths>...) read off sketches."""
    quantiles = [F.kll_sketch_get_quantile_double("values", F.lit(float(s))).alias(f"q{round(100 * s)}") for s in shares]
    return stored.select(*by, "n", F.hll_sketch_estimate("items").alias("distinct"), *quantiles)
