"""Baseline and current, pairs of snapshots, time alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order`` (a repeated key is overwritten)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def keyed_delta(current: DataFrame, baseline: DataFrame, key: list[str], measures: list[str], outer: bool = False) -> DataFrame:
    """key, and for each measure current_, baseline_ and delta_ columns; a missing side counts as 0. Keys only in the baseline show with ``outer``."""
    a = current.select(*key, *(F.col(m).alias(f"current_{m}") for m in measures))
    b = baseline.select(*key, *(F.col(m).alias(f"baseline_{m}") for m in measures))
    joined = a.join(b, key, "full_outer" if outer else "left")
    sides = [F.coalesce(F.col(f"{side}_{m}"), F.lit(0)).alias(f"{side}_{m}") for m in measures for side in ("current", "baseline")]
    filled = joined.select(*key, *sides)
    return filled.select("*", *((F.col(f"current_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}") for m in measures))


def regression_score(rate: Column, share_percent: Column, bytes_per_s: Column) -> Column:
    """Rise of the rate by the minute, twice the rise of the duration share in percent, rise of megabytes by the second; each counts from 0 up."""
    positive = lambda c: F.greatest(F.lit(0.0), c)
    return positive(rate) + 2 * positive(share_percent) + positive(bytes_per_s) / 1e6


def pairwise(df: DataFrame, keys: list[str], order: str, measures: list[str]) -> DataFrame:
    """Each snapshot with its change from the one before and from the first; null before the second."""
    window = Window.partitionBy(*keys).orderBy(order)
    steps = [(F.col(m) - F.lag(m).over(window)).alias(f"step_{m}") for m in measures]
    whole = [(F.col(m) - F.first(m).over(window)).alias(f"since_first_{m}") for m in measures]
    return df.select("*", *steps, *whole)


#: Alignment states and their scores.
NO_CLOCK, OVERLAP, NEARBY, APART = ("NO_SHARED_CLOCK", 35), ("ABSOLUTE_OVERLAP", 78), ("ABSOLUTE_SEQUENCE_NEARBY", 68), ("ABSOLUTE_NO_OVERLAP", 60)


def alignment(start_a: Column, end_a: Column, start_b: Column, end_b: Column, tolerance: Column | int) -> tuple[Column, Column]:
    """Status and score of two windows on one clock: no clock where an end is missing, overlap, a gap within the tolerance, or apart."""
    known = start_a.isNotNull() & end_a.isNotNull() & start_b.isNotNull() & end_b.isNotNull()
    gap = F.greatest(start_b - end_a, start_a - end_b)
    pick = lambda k: F.when(~known, F.lit(NO_CLOCK[k])).when(gap <= 0, F.lit(OVERLAP[k])).when(gap <= tolerance, F.lit(NEARBY[k])).otherwise(F.lit(APART[k]))
    return pick(0), pick(1)


def anchored(elapsed_s: Column, start_us: Column) -> Column:
    """Wall time in microseconds of an event that only knows the seconds since the start."""
    return start_us + F.round(elapsed_s * 1_000_000).cast("long")
