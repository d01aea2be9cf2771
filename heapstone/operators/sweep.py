"""A sweep over the starts and ends of spans: when how many artifacts are in distress at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end: spans of one key that overlap or touch joined, so that an artifact counts once at any time."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(start) <= F.col(end)).withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(False)).cast("int"))
    numbered = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def levels(spans: DataFrame, group: list[str], artifact: str, start: str, end: str) -> DataFrame:
    """group, start, end, n: stretches of time in which the same number of a group's artifacts, one at least, are within one of their spans.

    Each end counts after the starts at the same time, so spans that only touch don't part a stretch; a span without length is no stretch. Marks
    of one time are summed before they are put in order, neighbours of one level are one stretch.
    """
    once = merged_spans(spans.select(*group, artifact, start, end), [*group, artifact], start, end)
    marks = once.select(*group, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(once.select(*group, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = marks.groupBy(*group, "at").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*group).orderBy("at")
    counted = steps.select(*group, F.col("at").alias(start), F.lead("at").over(order).alias(end), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return counted.where("n > 0").select(*group, start, end, "n")


def summary(stretches: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """group, first, last, covered, most, most_from: when a group is in distress, for how long, and how many artifacts at the worst, first at ``most_from``."""
    worst = F.max_by(F.struct("n", start), F.struct("n", -F.col(start)))
    return stretches.groupBy(*group).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.sum(F.col(end) - F.col(start)).alias("covered"), worst.alias("w")).select(*group, "first", "last", "covered", F.col("w.n").alias("most"), F.col(f"w.{start}").alias("most_from"))
