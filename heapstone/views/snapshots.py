"""Focused views of thread dumps, crash logs, native memory, histograms, process maps, containers and OOM signals, over their parsers' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.operators.ranking import ratio, top_per_group
from heapstone.parse import incidents, memory, threads

KEY = ["artifact_id"]


def thread_states(lines: DataFrame) -> DataFrame:
    """artifact_id, state, n, place: states in the JVM's order."""
    rows = threads.threads(lines)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, threads.STATES)), F.col("state")), F.lit(0)), F.lit(len(threads.STATES) + 1))
    return rows.groupBy(*KEY, "state").agg(F.count("*").alias("n")).withColumn("place", place)


def blocked_clusters(lines: DataFrame, limit: int = 6) -> DataFrame:
    """The monitors with most waiting threads: artifact_id, position, monitor, waiters, blocked, owner."""
    found = threads.hotspots(threads.threads(lines))
    return top_per_group(found, KEY, [F.desc("blocked"), F.desc("waiters"), F.col("monitor")], limit).select(*KEY, "position", "monitor", "waiters", "blocked", "owner")


def reservation_gaps(lines: DataFrame, limit: int = 5) -> DataFrame:
    """Native categories by reserved but uncommitted memory, without heap and metaspace: artifact_id, position, category, gap_kb, commit_ratio."""
    rows = memory.nmt_categories(lines).where(~F.col("category").isin("Java Heap", "Metaspace"))
    gaps = rows.select(*KEY, "category", F.greatest(F.lit(0), F.col("reserved_kb") - F.col("committed_kb")).alias("gap_kb"), ratio(F.col("committed_kb"), F.col("reserved_kb")).alias("commit_ratio")).where("gap_kb > 0")
    return top_per_group(gaps, KEY, [F.desc("gap_kb"), F.col("category")], limit)


def category_deltas(lines: DataFrame, limit: int = 8) -> DataFrame:
    """Native categories by growth of committed memory: artifact_id, position, category, committed_kb, committed_delta_kb."""
    rows = memory.nmt_categories(lines).where("committed_delta_kb IS NOT NULL").select(*KEY, "category", "committed_kb", "committed_delta_kb")
    return top_per_group(rows, KEY, [F.desc("committed_delta_kb"), F.col("category")], limit)


def top_consumers(lines: DataFrame, limit: int = 10) -> DataFrame:
    """Classes by bytes: artifact_id, position, class_name, bytes, instances."""
    return top_per_group(memory.histogram(lines).select(*KEY, "class_name", "bytes", "instances", "rank"), KEY, [F.desc("bytes"), F.col("rank")], limit).drop("rank")


def growth_ranking(pairs: DataFrame, rows: DataFrame, limit: int = 10) -> DataFrame:
    """Classes of the current histogram by growth in bytes over the baseline: pair_id, position, class_name, growth_bytes, growth_instances. pairs: pair_id, baseline_id, current_id."""
    last = lambda key, p: pairs.join(rows.withColumnRenamed("artifact_id", key), key).groupBy("pair_id", "class_name").agg(F.max(F.struct("rank", "bytes", "instances")).alias(p))
    joined = last("current_id", "c").join(last("baseline_id", "b"), ["pair_id", "class_name"], "left")
    change = lambda m: (F.col(f"c.{m}") - F.coalesce(F.col(f"b.{m}"), F.lit(0))).alias(f"growth_{m}")
    grown = joined.select("pair_id", "class_name", change("bytes"), change("instances")).where("growth_bytes > 0")
    return top_per_group(grown, ["pair_id"], [F.desc("growth_bytes"), F.col("class_name")], limit)


def top_mappings(lines: DataFrame, measure: str = "rss_kb", limit: int = 10) -> DataFrame:
    """Mappings by a size, positive ones only: artifact_id, position, address, category, the size."""
    rows = memory.pmap(lines).where(F.col(measure) > 0).select(*KEY, "address", "category", measure)
    return top_per_group(rows, KEY, [F.desc(measure), F.col("address")], limit)


def memory_budget(lines: DataFrame) -> DataFrame:
    """What a container uses of its limits and by what."""
    return memory.cgroup_summary(lines).select(*KEY, "current_bytes", "max_bytes", "high_bytes", "headroom_to_max_bytes", "usage_of_max_ratio", "usage_of_high_ratio", "anon_bytes", "file_bytes")


def container_events(lines: DataFrame) -> DataFrame:
    return memory.cgroup_summary(lines).select(*KEY, "high_events", "max_events", "oom_events", "oom_kill_events", "throttled", "throttled_ms", "throttled_ratio")


def kernel_kills(lines: DataFrame, year: int, limit: int = 10) -> DataFrame:
    """The latest kills: artifact_id, position, event_ts, pid, process, anon_rss_kb."""
    rows = incidents.kernel_events(lines, year).where("killed").select(*KEY, "event_ts", "pid", "process", "anon_rss_kb", "line_no")
    return top_per_group(rows, KEY, [F.desc_nulls_last("event_ts"), F.desc("line_no")], limit).drop("line_no")


