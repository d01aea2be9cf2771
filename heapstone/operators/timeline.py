"""Operators on ordered events: clusters, streaks, windows, representatives. All take column names and work within ``keys``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronology(line: str, clock: str) -> list[Column]:
    """Rows with a line number first, by line, then by clock."""
    return [F.when(F.col(line) > 0, F.lit(0)).otherwise(F.lit(1)), F.coalesce(F.col(line), F.lit(0)), F.col(clock)]


def islands(df: DataFrame, keys: list[str], order: list, breaks: Column, out: str = "cluster") -> DataFrame:
    """Adds a number, from 0, that rises at each row where ``breaks`` is true."""
    return df.withColumn(out, F.sum(F.coalesce(breaks, F.lit(False)).cast("long")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def gap_clusters(df: DataFrame, keys: list[str], clock: str, line: str, gap, line_gap, out: str = "cluster") -> DataFrame:
    """Neighbours stay together if they are within ``gap`` on the clock or within ``line_gap`` lines, both inclusive; a missing line counts as 0."""
    window = Window.partitionBy(*keys).orderBy(*chronology(line, clock))
    near_clock = F.col(clock) - F.lag(clock).over(window) <= gap
    near_line = F.coalesce(F.col(line), F.lit(0)) - F.coalesce(F.lag(line).over(window), F.lit(0)) <= line_gap
    first = F.row_number().over(window) == 1
    marked = df.withColumn("_break", ~first & ~(F.coalesce(near_clock, F.lit(False)) | near_line))
    return islands(marked, keys, chronology(line, clock), F.col("_break"), out).drop("_break")


def best_gap_cluster(df: DataFrame, keys: list[str], clock: str, line: str, weight: Column, gap, line_gap) -> DataFrame:
    """keys, cluster, n, weight, first_line, last_line: of each group's clusters the largest, then the heaviest, the shortest in lines, the earliest."""
    clusters = gap_clusters(df, keys, clock, line, gap, line_gap).groupBy(*keys, "cluster").agg(
        F.count("*").alias("n"), F.sum(weight).alias("weight"), F.min(line).alias("first_line"), F.max(line).alias("last_line")
    )
    order = [F.desc("n"), F.desc("weight"), F.col("last_line") - F.col("first_line"), F.col("cluster")]
    window = Window.partitionBy(*keys).orderBy(*order)
    return clusters.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def interval_clusters(df: DataFrame, keys: list[str], start: str, end: str, slack, tie: str, out: str = "cluster") -> DataFrame:
    """A new cluster begins where an interval starts more than ``slack`` after all earlier ones have ended."""
    window = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_break", F.col(start) > F.max(end).over(window) + slack)
    return islands(marked, keys, [start, tie], F.col("_break"), out).drop("_break")


def longest_streak(df: DataFrame, keys: list[str], order: list, flag: Column) -> DataFrame:
    """keys, streak: the longest run of rows with ``flag``; 0 where it never holds."""
    everything, flagged = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, "_flag").orderBy(*order)
    runs = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_run", F.row_number().over(everything) - F.row_number().over(flagged))
    lengths = runs.groupBy(*keys, "_flag", "_run").agg(F.count("*").alias("_n"))
    return lengths.groupBy(*keys).agg(F.max(F.when(F.col("_flag"), F.col("_n")).otherwise(F.lit(0))).alias("streak"))


def densest_window(df: DataFrame, keys: list[str], line: str, width: int, weight: Column) -> DataFrame:
    """keys, first_line, n, weight: the window of ``width`` lines after a row's line (inclusive) with the most rows, then weight, then the earliest."""
    window = Window.partitionBy(*keys).orderBy(line).rangeBetween(0, width)
    sized = df.select(*keys, F.col(line).alias("first_line"), F.count("*").over(window).alias("n"), F.sum(weight).over(window).alias("weight"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("weight"), "first_line")
    return sized.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def around_first(df: DataFrame, keys: list[str], order: list, first: Column, counted: Column) -> DataFrame:
    """keys, first_index (null: never), before, after: rows with ``counted`` strictly before and after the first row with ``first``."""
    indexed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    at = F.min(F.when(first, F.col("_i"))).over(Window.partitionBy(*keys))
    marked = indexed.withColumn("_at", at)
    hits = F.coalesce(counted, F.lit(False))
    return marked.groupBy(*keys).agg(
        F.min("_at").alias("first_index"),
        F.count_if(hits & F.coalesce(F.col("_i") < F.col("_at"), F.lit(True))).alias("before"),
        F.count_if(hits & F.coalesce(F.col("_i") > F.col("_at"), F.lit(False))).alias("after"),
    )


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group by ``order`` (given descending), with ``recency`` from 1."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("recency") <= n)


def representatives(df: DataFrame, keys: list[str], order: list[str], importance: str, limit: int) -> DataFrame:
    """First and last row of each group and the ``limit`` - 2 most important ones (ties: the earlier), each once."""
    window = Window.partitionBy(*keys)
    ranked = df.withColumn("_first", F.row_number().over(window.orderBy(*order))).withColumn("_last", F.row_number().over(window.orderBy(*(F.desc(c) for c in order)))).withColumn("_top", F.row_number().over(window.orderBy(F.desc(importance), *order)))
    return ranked.where((F.col("_first") == 1) | (F.col("_last") == 1) | (F.col("_top") <= limit - 2)).drop("_first", "_last", "_top")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], points: int) -> DataFrame:
    """The rows at round(i * (n - 1) / (points - 1)) for i = 0 ... points - 1; all rows where there are no more than ``points``."""
    window = Window.partitionBy(*keys)
    placed = df.withColumn("_i", F.row_number().over(window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(window))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(points - 1) + 0.5))
    return placed.where((F.col("_n") <= points) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def resolve_window(start: Column | None, end: Column | None, anchor: Column | None, width: Column | None, default_width: float = 15.0) -> tuple[Column, Column]:
    """An inclusive window: explicit ends, or the anchor half a width to each side; ends in the wrong order are swapped, none is below 0."""
    null = F.lit(None).cast("double")
    start, end, anchor = (null if c is None else c.cast("double") for c in (start, end, anchor))
    width = F.coalesce(null if width is None else width.cast("double"), F.lit(default_width))
    low = F.coalesce(start, anchor - width / 2, end - width)
    high = F.coalesce(end, anchor + width / 2, start + width)
    return F.greatest(F.lit(0.0), F.least(low, high)), F.greatest(F.lit(0.0), F.greatest(low, high))


def overlap_join(events: DataFrame, windows: DataFrame, start: str, end: str, low: str, high: str, slack=0, cell: int = 0) -> DataFrame:
    """Events with each window that they overlap, ends inclusive, ``slack`` to each side.

    With ``cell`` both sides are dealt to cells of that many clock units and joined on the cell, for many windows; the pair is taken in the
    first cell that both touch. Without it the condition stands alone, for a table of windows that Spark may broadcast by its size.
    """
    touches = (F.col(start) <= F.col(high) + slack) & (F.col(end) >= F.col(low) - slack)
    if not cell:
        return events.join(windows, touches)
    at = lambda c: F.floor(c / cell)
    left = events.withColumn("_cell", F.explode(F.sequence(at(F.col(start)), at(F.col(end)))))
    right = windows.withColumn("_wcell", F.explode(F.sequence(at(F.col(low) - slack), at(F.col(high) + slack))))
    once = F.col("_cell") == F.greatest(at(F.col(start)), at(F.col(low) - slack))
    return left.join(right, (F.col("_cell") == F.col("_wcell")) & touches & once).drop("_cell", "_wcell")


def nearest_gap(left: DataFrame, right: DataFrame, keys: list[str], left_end: str, right_start: str, left_id: str, right_id: str, tolerance: int) -> DataFrame:
    """keys, left_id, right_id, gap: for each left row the right row of its group with the smallest absolute gap within ``tolerance``; ties to the smaller right id.

    An as-of search in both directions: both sides stand in one ordered window, each left row sees the last right row before and the first after,
    found by a second window in falling order, so both grow with the rows.
    """
    a = left.select(*keys, F.col(left_end).alias("_t"), F.col(left_id).alias(left_id), F.lit(None).cast("long").alias("_r"))
    b = right.groupBy(*keys, F.col(right_start).alias("_t")).agg(F.min(right_id).cast("long").alias("_r")).select(*keys, "_t", F.lit(None).cast("long").alias(left_id), "_r")
    upward, downward = (Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.col("_t"), F.desc("_t")))
    seen = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    both = a.unionByName(b).withColumn("_seen", seen)
    near = both.withColumn("_before", F.last("_seen", True).over(upward)).withColumn("_after", F.last("_seen", True).over(downward))
    option = lambda c: F.when(F.col(c).isNotNull() & (F.abs(F.col(f"{c}.t") - F.col("_t")) <= tolerance), F.struct(F.abs(F.col(f"{c}.t") - F.col("_t")).alias("gap"), F.col(f"{c}.r").alias("id")))
    best = F.array_min(F.filter(F.array(option("_before"), option("_after")), lambda x: x.isNotNull()))
    return near.where(F.col(left_id).isNotNull()).withColumn("_best", best).where(F.col("_best").isNotNull()).select(*keys, left_id, F.col("_best.id").alias(right_id), F.col("_best.gap").alias("gap"))
