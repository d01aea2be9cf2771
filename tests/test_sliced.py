"""Sliced operators give what plain windows give, with slices of any size, nulls and ties, and share one group among tasks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heapstone.operators import context, sliced
from heapstone.operators import timeline as t

SCHEMA = "k string, line int, clock double, stop double, head string, bad boolean, id int"


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        line = rng.choice([None, *[i + 1] * 9])
        clock = rng.choice([None, *[round(i * 0.7 + rng.random() * rng.choice([0.1, 9]), 3)] * 6])
        out.append((rng.choice("aab"), line, clock, None if clock is None else clock + rng.choice([0.0, 0.2, 30.0]), rng.choice([None, None, None, f"h{i}"]), rng.choice([True, True, False, None]), i))
    return out


def same(a, b):
    return Counter(map(tuple, a.select(*sorted(a.columns)).collect())) == Counter(map(tuple, b.select(*sorted(b.columns)).collect()))


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_as_plain_windows(spark, size):
    df = spark.createDataFrame(rows(size), SCHEMA)
    by = sliced.by_lines("line", size)
    assert same(sliced.gap_clusters(df, ["k"], "clock", "line", 2.0, 3, by), t.gap_clusters(df, ["k"], "clock", "line", 2.0, 3))
    numbered = df.where("line IS NOT NULL").withColumnRenamed("line", "line_no")
    by_no = sliced.by_lines("line_no", size)
    assert same(sliced.carried(numbered, ["k"], ["line_no"], F.col("head"), "section", by_no), context.section_of(numbered, ["k"], F.col("head")))
    assert same(sliced.longest_streak(numbered, ["k"], ["line_no"], F.col("bad"), by_no), t.longest_streak(numbered, ["k"], ["line_no"], F.col("bad")))
    timed = df.where("clock IS NOT NULL")
    by_clock = F.floor(F.col("clock") / (size / 3))
    assert same(sliced.interval_clusters(timed, ["k"], "clock", "stop", 0.5, "id", by_clock), t.interval_clusters(timed, ["k"], "clock", "stop", 0.5, "id"))


def test_one_long_group_is_the_work_of_many_tasks(spark):
    lines = spark.range(300_000).selectExpr("'a' AS artifact_id", "CAST(id + 1 AS INT) AS line_no", "CAST(id AS DOUBLE) * IF(id % 1000 = 0, 2, 1) AS clock")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sliced.carried(lines, ["artifact_id"], ["line_no"], F.when(F.col("line_no") % 50_000 == 1, F.col("line_no")), "head", sliced.by_lines("line_no", 5000))
        tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 300_000
        assert [r["n"] for r in found.groupBy("head").agg(F.count("*").alias("n")).orderBy("head").collect()] == [50_000] * 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    by = sliced.by_lines("line")
    assert sliced.gap_clusters(df, ["k"], "clock", "line", 2.0, 3, by).count() == sliced.carried(df, ["k"], ["line"], F.col("head"), "s", by).count() == sliced.longest_streak(df, ["k"], ["line"], F.col("bad"), by).count() == 0
