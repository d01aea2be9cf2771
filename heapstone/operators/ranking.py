"""Ranked breakdowns, dominant keys, first-wins unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0.0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ranked_share(df: DataFrame, key: str, limit: int, weight: str | None = None) -> DataFrame:
    """key, n, weight total (if any), shares: the ``limit`` largest by count (then weight, then key), and whether more exist.

    Blank keys are left out. Shares are of all rows with a key, not of the ranked ones.
    """
    named = df.where(F.trim(F.col(key).cast("string")) != "")
    totals = named.groupBy(key).agg(F.count("*").alias("n"), *([F.sum(weight).alias("total")] if weight else []))
    overall = totals.agg(F.sum("n").alias("_n"), F.count("*").alias("_keys"), *([F.sum("total").alias("_total")] if weight else []))
    order = [F.desc("n"), *([F.desc("total")] if weight else []), F.asc(key)]
    top = totals.orderBy(*order).limit(limit).crossJoin(F.broadcast(overall))
    shares = [ratio(F.col("n"), F.col("_n")).alias("share"), *([F.col("total"), ratio(F.col("total"), F.col("_total")).alias("total_share")] if weight else [])]
    return top.select(key, "n", *shares, (F.col("_keys") > limit).alias("more_available"))


def dominant(df: DataFrame, group: list[str], key: str, amount: Column, first: str) -> DataFrame:
    """group, the key with the largest summed amount, the amount: ties go to the key seen first by ``first``, then to the smaller key."""
    sums = df.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.sum(amount).alias("amount"), F.min(first).alias("_first"))
    best = F.max(F.struct(F.col("amount"), (-F.col("_first")).alias("f"), F.col(key)))
    return sums.groupBy(*group).agg(best.alias("b")).select(*group, F.col(f"b.{key}").alias(key), F.col("b.amount").alias("amount"))


def top_rows(df: DataFrame, order: list[Column], limit: int, positive: str | None = None) -> DataFrame:
    """The first ``limit`` rows by ``order`` among those whose ``positive`` column is above zero."""
    return (df.where(F.col(positive) > 0) if positive else df).orderBy(*order).limit(limit)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, with ``position`` from 1; Spark limits each task before the shuffle."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= limit)


def first_wins(frames: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """All rows of all frames, one for each key: from the earliest frame, then by ``order``."""
    joined = None
    for place, frame in enumerate(frames):
        marked = frame.withColumn("_place", F.lit(place))
        joined = marked if joined is None else joined.unionByName(marked, allowMissingColumns=True)
    window = Window.partitionBy(*key).orderBy("_place", *order)
    return joined.withColumn("_r", F.row_number().over(window)).where(F.col("_r") == 1).drop("_r", "_place")


def counts_in_order(df: DataFrame, key: str, preferred: list[str]) -> DataFrame:
    """key, n, place: preferred keys in their order, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(key))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("_p", F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1)))
    return counts.select(key, "n", F.row_number().over(Window.orderBy("_p", key)).alias("place"))


def merged(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each key with the columns of all frames, each of which has at most one row a key: a union and one aggregation, no joins."""
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame, allowMissingColumns=True)
    return everything.groupBy(*keys).agg(*(F.max(c).alias(c) for c in everything.columns if c not in keys))
