"""Ordered operators that share one long group among many tasks: each slice by itself, then what one slice needs of those before it.

``slice_by`` cuts a group along its order: it must not fall from one row to the next, and rows that are equal in ``order`` must be in one slice.
A slice is summed up in one row (its last row, its last value, its greatest value, its count), these rows are put in order, and each slice is
given what came before. The results are those of a plain window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.ordered import running_total
from heapstone.operators.timeline import chronology


def by_lines(line: str, size: int = 100_000) -> Column:
    """Slices of ``size`` lines; rows without a line are the last slice, as chronological order has them last."""
    return F.when(F.col(line) > 0, F.floor(F.col(line) / size)).otherwise(F.lit((1 << 62)))


def _with_before(df: DataFrame, keys: list[str], slice_by: Column, last, carry) -> DataFrame:
    """``df`` with _s, the slice, and _before: ``carry`` over the slices before of what ``last`` makes of each."""
    cut = df.withColumn("_s", slice_by)
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_s").agg(last.alias("_end")).select(*keys, "_s", carry(F.col("_end"), earlier).alias("_before"))
    return cut.join(before, [*keys, "_s"])


def _inside(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys, "_s").orderBy(*order)


def _place(order: list) -> Column:
    """A value that orders as ``order`` does, which must be ascending."""
    return F.struct(*((c if isinstance(c, Column) else F.col(c)).alias(f"o{k}") for k, c in enumerate(order)))


def carried(df: DataFrame, keys: list[str], order: list, value: Column, out: str, slice_by: Column) -> DataFrame:
    """Adds ``out``: the last ``value`` that isn't null at or before each row, as headers hold for the lines below them."""
    at = F.when(F.col(out).isNotNull(), _place(order))
    valued = df.withColumn(out, value)
    joined = _with_before(valued, keys, slice_by, F.max_by(F.col(out), at), lambda end, earlier: F.last(end, True).over(earlier))
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.coalesce(F.last(out, True).over(upto), F.col("_before"))).drop("_s", "_before")


def previous(df: DataFrame, keys: list[str], order: list, columns: list[str], slice_by: Column) -> DataFrame:
    """Adds ``_first``, whether a row is the first of its group, and ``_previous``, a struct of ``columns`` of the row before it."""
    row = F.struct(*columns)
    joined = _with_before(df, keys, slice_by, F.max_by(row, _place(order)), lambda end, _: F.lag(end).over(Window.partitionBy(*keys).orderBy("_s")))
    inside = _inside(keys, order)
    opens = F.row_number().over(inside) == 1
    told = joined.withColumn("_previous", F.when(opens, F.col("_before")).otherwise(F.lag(row).over(inside))).withColumn("_first", opens & F.col("_before").isNull())
    return told.drop("_s", "_before")


def greatest_before(df: DataFrame, keys: list[str], order: list, value: str, out: str, slice_by: Column) -> DataFrame:
    """Adds ``out``: the greatest ``value`` of all rows before each one."""
    joined = _with_before(df, keys, slice_by, F.max(value), lambda end, earlier: F.max(end).over(earlier))
    earlier = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.greatest(F.max(value).over(earlier), F.col("_before"))).drop("_s", "_before")


def numbered(df: DataFrame, keys: list[str], order: list, breaks: Column, out: str, slice_by: Column) -> DataFrame:
    """Adds a number, from 0, that rises at each row where ``breaks`` is true."""
    marked = df.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("long"))
    return running_total(marked, keys, order, "_b", out, slice_by).drop("_b")


def gap_clusters(df: DataFrame, keys: list[str], clock: str, line: str, gap, line_gap, slice_by: Column, out: str = "cluster") -> DataFrame:
    """As ``timeline.gap_clusters``: neighbours within ``gap`` on the clock or ``line_gap`` lines stay together."""
    order = chronology(line, clock)
    told = previous(df, keys, order, [clock, line], slice_by)
    near_clock = F.col(clock) - F.col("_previous")[clock] <= gap
    near_line = F.coalesce(F.col(line), F.lit(0)) - F.coalesce(F.col("_previous")[line], F.lit(0)) <= line_gap
    marked = told.withColumn("_break", ~F.col("_first") & ~(F.coalesce(near_clock, F.lit(False)) | near_line)).drop("_previous", "_first")
    return numbered(marked, keys, order, F.col("_break"), out, slice_by).drop("_break")


def interval_clusters(df: DataFrame, keys: list[str], start: str, end: str, slack, tie: str, slice_by: Column, out: str = "cluster") -> DataFrame:
    """As ``timeline.interval_clusters``: a new one where an interval starts more than ``slack`` after all earlier ones have ended."""
    told = greatest_before(df, keys, [start, tie], end, "_end", slice_by)
    marked = told.withColumn("_break", F.col(start) > F.col("_end") + slack).drop("_end")
    return numbered(marked, keys, [start, tie], F.col("_break"), out, slice_by).drop("_break")


def longest_streak(df: DataFrame, keys: list[str], order: list, flag: Column, slice_by: Column) -> DataFrame:
    """As ``timeline.longest_streak``: rows between two that break a streak bear one number, and are counted by it."""
    held = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    runs = numbered(held, keys, order, ~F.col("_flag"), "_run", slice_by)
    return runs.groupBy(*keys, "_run").agg(F.count_if("_flag").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("streak"))
