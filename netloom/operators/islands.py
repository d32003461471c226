"""Gaps and islands: runs of values whose neighbours lie within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """by, cluster, n, low, high, middle: values in order, a new cluster where the gap is more than tolerance; middle is the upper median."""
    order = Window.partitionBy(*by).orderBy(value)
    starts = F.coalesce(F.col(value) - F.lag(value).over(order) > tolerance, F.lit(True)).cast("bigint")
    marked = df.select(*by, value).withColumn("start", starts)
    # by range: equal values are of one cluster, whichever of them is the first
    numbered = marked.withColumn("cluster", F.sum("start").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.array_sort(F.collect_list(value)).alias("all"))
    return grouped.withColumn("middle", F.get("all", F.floor(F.col("n") / 2).cast("int"))).drop("all")


def snapped(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """df with snapped: the middle of each value's cluster."""
    clusters = gap_clusters(df, by, value, tolerance).select(*by, "low", "high", F.col("middle").alias("snapped"))
    right = clusters.toDF(*[f"_{x}" for x in by], "_low", "_high", "snapped")
    on = F.col(value).between(F.col("_low"), F.col("_high"))
    for x in by:
        on &= F.col(x) == F.col(f"_{x}")
    return df.join(right, on).select(*df.columns, "snapped")


def profile_runs(bins: DataFrame, by: list[str], place: str, weight: str, gap: int = 3, least: int = 1) -> DataFrame:
    """by, run, centre (whole mean place), support: runs of bins that hold something, split by gaps of more than gap; runs of less support go."""
    full = bins.where(F.col(weight) > 0)
    order = Window.partitionBy(*by).orderBy(place)
    starts = F.coalesce(F.col(place) - F.lag(place).over(order) > gap, F.lit(True)).cast("bigint")
    numbered = full.withColumn("_start", starts).withColumn("run", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*by, "run").agg(F.floor(F.avg(place)).alias("centre"), F.sum(weight).alias("support"))
    return out.where(F.col("support") >= least)
