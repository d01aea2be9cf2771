"""Exact ranks within groups from digit histograms, without a sort of a whole group in one task.

A key is a string of digits that orders as its bytes do. Counts by ever longer prefixes of the key (two digits more at a time, those that all
keys share left out) stop where no bucket holds more than a task's worth of rows. Counts of shorter prefixes are sums of these, and a
bucket's first rank is its parent's plus the counts of the smaller children, so only buckets are sorted.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.llm.common import Store

#: Digits that one more level of the histogram reads.
STEP = 2


def long_digits(value: Column) -> Column:
    """Digits that order as the integers do, nulls first; more digits may follow."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("0"))


def text_digits(value: Column) -> Column:
    """Digits that order as the UTF-8 bytes of the texts do, nulls first; nothing may follow."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), F.hex(value)))


def _counts(df: DataFrame, store: Store, group: list[str], key: str, copies: str, most: int) -> list[tuple[int, DataFrame]]:
    """Length of prefix and counts (group, _p, n), from the groups as a whole down to buckets of at most ``most`` rows."""
    low, high, longest = df.agg(F.min(key), F.max(key), F.max(F.length(key))).first()
    if low is None:
        return []
    cut = skip = len(os.path.commonprefix([low, high]))
    while True:
        finest = store.keep(df.groupBy(*group, F.substring(key, 1, cut).alias("_p")).agg(F.sum(copies).alias("n"), F.count("*").alias("_rows")))
        if finest.agg(F.max("_rows")).first()[0] <= most or cut >= longest:
            break
        store.drop(finest)
        cut += STEP
    levels = [(cut, finest.drop("_rows"))]
    for length in range(cut - STEP, skip - 1, -STEP):
        levels.append((length, levels[-1][1].groupBy(*group, F.substring("_p", 1, length).alias("_p")).agg(F.sum("n").alias("n"))))
    return levels[::-1]


def ranks(df: DataFrame, store: Store, group: list[str], key: str, copies: str, rank: str, size: str, most: int = 4096) -> DataFrame:
    """``df`` with ``rank``, the copies of smaller keys in its group, and ``size``, all copies of the group.

    Rows must be distinct in group and key (equal ones counted in ``copies``) and groups not null. An empty table stays empty.
    """
    levels = _counts(df, store, group, key, copies, most)
    if not levels:
        return df.withColumn(rank, F.lit(0).cast("long")).withColumn(size, F.lit(0).cast("long"))
    (above, top), *finer = levels
    starts = top.select(*group, "_p", F.lit(0).cast("long").alias("_start"), F.col("n").alias("_size"))
    for length, level in finer:
        before = Window.partitionBy(*group, "_up").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        within = level.withColumn("_up", F.substring("_p", 1, above)).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        parents = starts.withColumnRenamed("_p", "_up")
        starts = within.join(parents, [*group, "_up"]).select(*group, "_p", (F.col("_start") + F.col("_before")).alias("_start"), "_size")
        above = length
    inside = Window.partitionBy(*group, "_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_p", F.substring(key, 1, above)).join(starts, [*group, "_p"])
    return placed.withColumn(rank, F.col("_start") + F.coalesce(F.sum(copies).over(inside), F.lit(0))).withColumnRenamed("_size", size).drop("_p", "_start")


def each_copy(df: DataFrame, copies: str, rank: str, most: int = 4096) -> DataFrame:
    """One row a copy, at consecutive ranks; a row of very many copies is opened in blocks."""
    blocks = df.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / most))))
    last = F.least(F.col(copies), (F.col("_b") + 1) * most) - 1
    return blocks.withColumn("_k", F.explode(F.sequence(F.col("_b") * most, last))).withColumn(rank, F.col(rank) + F.col("_k")).drop("_b", "_k", copies)
