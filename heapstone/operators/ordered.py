"""Ordered analytics that stay parallel inside a group: running totals and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that a group's value range is cut into.
SLICES = 64


def value_slices(df: DataFrame, value: str) -> Column:
    """The slice of a row's value: boundaries are approximate quantiles of the whole column (SLICES - 1 numbers), so they only affect balance."""
    shares = F.array(*(F.lit(k / SLICES) for k in range(1, SLICES)))
    bounds = df.agg(F.percentile_approx(value, shares, F.lit(1000)).alias("b")).first()["b"] or []
    return F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.expr("cast(array() as array<double>)"), lambda b: b < F.col(value)))


def running_total(df: DataFrame, keys: list[str], order: list, amount: str, out: str, slice_by: Column) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` up to and with this row. ``slice_by`` must not fall along ``order``; each slice is summed by itself."""
    cut = df.withColumn("_slice", slice_by)
    within = [*keys, "_slice"]
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*within).agg(F.sum(amount).alias("_sum")).select(*within, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    window = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, within).withColumn(out, F.col("_offset") + F.sum(amount).over(window)).drop("_slice", "_offset")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column for each named share: the smallest value whose rank is ceil(share * n) or more, per group; nulls don't count.

    Equal values are counted before the shuffle, and value ranges are summed apart, so a group may hold any share of the rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    upto = running_total(counted, keys, [value], "_n", "_upto", value_slices(counted, value))
    summed = upto.join(totals, keys) if keys else upto.crossJoin(F.broadcast(totals))
    return summed.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all")), F.col(value))).alias(name) for name, p in shares.items()))
