"""Rules for a baseline and a current artifact of one kind: both summaries side by side as b_ and c_ columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.rules import Rule, evaluate

_SAME = "b_collector = c_collector"

GC = (
    Rule("compare-gc-collector-change", "trim(b_collector) <> '' AND trim(c_collector) <> '' AND b_collector <> c_collector", "MEDIUM", (("HIGH", "c_p95_pause_ms >= 250 OR c_full_gc_count >= 2"),)),
    Rule("compare-gc-pause-regression", "c_p95_pause_ms > 0 AND ((b_p95_pause_ms <= 0 AND c_p95_pause_ms >= 100) OR (b_p95_pause_ms > 0 AND c_p95_pause_ms >= greatest(100, 1.75 * b_p95_pause_ms) AND c_p95_pause_ms - b_p95_pause_ms >= 40) OR c_max_pause_ms >= greatest(250, b_max_pause_ms + 100) OR c_stop_the_world_pct >= greatest(5, 1.5 * b_stop_the_world_pct + 2))", "HIGH", (("CRITICAL", "c_max_pause_ms >= 1000 OR c_p95_pause_ms >= 750 OR c_stop_the_world_pct >= 20"),)),
    Rule("compare-gc-full-gc-regression", "c_full_gc_count > 0 AND ((b_full_gc_count = 0 AND c_full_gc_count >= 2) OR c_full_gc_count >= b_full_gc_count + 2 OR (b_max_full_gc_pause_ms > 0 AND c_max_full_gc_pause_ms >= b_max_full_gc_pause_ms + 100) OR (c_full_gc_count >= b_full_gc_count + 1 AND c_peak_post_gc_occupancy_ratio >= 0.95))", "HIGH", (("CRITICAL", "c_full_gc_count >= 5 OR c_max_full_gc_pause_ms >= 500 OR c_peak_post_gc_occupancy_ratio >= 0.98"),)),
    Rule("compare-gc-headroom-regression", "c_peak_post_gc_occupancy_ratio > 0 AND ((b_peak_post_gc_occupancy_ratio <= 0 AND c_peak_post_gc_occupancy_ratio >= 0.90) OR (c_peak_post_gc_occupancy_ratio >= b_peak_post_gc_occupancy_ratio + 0.05 AND c_peak_post_gc_occupancy_ratio >= 0.90) OR c_near_capacity_count >= b_near_capacity_count + 2 OR (b_average_post_gc_occupancy_ratio > 0 AND c_average_post_gc_occupancy_ratio >= b_average_post_gc_occupancy_ratio + 0.05 AND c_average_post_gc_occupancy_ratio >= 0.85))", "HIGH", (("CRITICAL", "c_peak_post_gc_occupancy_ratio >= 0.98 OR c_near_capacity_count >= 3"),)),
    Rule("compare-gc-g1-distress-regression", f"{_SAME} AND c_collector = 'G1' AND (c_evacuation_failure_pause_count > b_evacuation_failure_pause_count OR c_to_space_exhausted_count > b_to_space_exhausted_count OR c_full_compaction_attempt_count > b_full_compaction_attempt_count OR c_low_reclaim_full_count > b_low_reclaim_full_count)", "HIGH", (("CRITICAL", "c_to_space_exhausted_count > b_to_space_exhausted_count OR c_full_compaction_attempt_count > b_full_compaction_attempt_count"),)),
    Rule("compare-gc-cms-fallback-regression", f"{_SAME} AND c_collector = 'CMS' AND (c_concurrent_mode_failure_count > b_concurrent_mode_failure_count OR c_promotion_failed_count > b_promotion_failed_count OR c_concurrent_phase_count > b_concurrent_phase_count OR coalesce(c_longest_concurrent_phase_ms, 0) - coalesce(b_longest_concurrent_phase_ms, 0) > 250)", "HIGH", (("CRITICAL", "c_concurrent_mode_failure_count > b_concurrent_mode_failure_count OR c_promotion_failed_count > b_promotion_failed_count"),)),
    Rule("compare-gc-stop-the-world-pressure-regression", f"{_SAME} AND c_collector IN ('Serial', 'Parallel') AND NOT (c_full_gc_streak - b_full_gc_streak <= 1 AND coalesce(c_average_full_post_gc_occupancy_ratio, 0) - coalesce(b_average_full_post_gc_occupancy_ratio, 0) < 0.05 AND coalesce(c_average_reclaimed_mb, 0) - coalesce(b_average_reclaimed_mb, 0) <= 0)", "MEDIUM", (("HIGH", "c_full_gc_streak - b_full_gc_streak > 1 OR coalesce(c_average_full_post_gc_occupancy_ratio, 0) - coalesce(b_average_full_post_gc_occupancy_ratio, 0) >= 0.08"),)),
    Rule("compare-gc-zgc-stall-regression", f"{_SAME} AND c_collector = 'ZGC' AND NOT (c_allocation_stall_count - b_allocation_stall_count <= 0 AND coalesce(c_max_allocation_stall_ms, 0) - coalesce(b_max_allocation_stall_ms, 0) < 5 AND coalesce(c_total_allocation_stall_ms, 0) - coalesce(b_total_allocation_stall_ms, 0) < 10 AND coalesce(c_longest_concurrent_phase_ms, 0) - coalesce(b_longest_concurrent_phase_ms, 0) < 100)", "MEDIUM", (("HIGH", "c_allocation_stall_count > b_allocation_stall_count OR coalesce(c_max_allocation_stall_ms, 0) - coalesce(b_max_allocation_stall_ms, 0) >= 10"),)),
)

HISTOGRAM = (
    Rule("compare-heap-growth", "top_growth_bytes > 500000", "HIGH"),
    Rule("compare-heap-retention-pattern", "c_cache_like_bytes - b_cache_like_bytes >= 2000000 OR c_collection_like_bytes - b_collection_like_bytes >= 4000000 OR c_cache_like_instances - b_cache_like_instances >= 20000", "HIGH"),
    Rule("compare-heap-payload-growth", "c_payload_like_bytes - b_payload_like_bytes >= 2000000 OR c_payload_like_instances - b_payload_like_instances >= 50000", "MEDIUM"),
)

NMT = (
    Rule("compare-nmt-native-growth", "c_committed_kb - b_committed_kb >= 16384", "HIGH"),
    Rule("compare-nmt-internal-arena-growth", "c_internal_committed_kb - b_internal_committed_kb >= 16384 AND (c_internal_committed_kb - b_internal_committed_kb >= 0.35 * (c_committed_kb - b_committed_kb) OR c_internal_committed_kb - b_internal_committed_kb >= 24576)", "MEDIUM", (("HIGH", "c_internal_committed_kb - b_internal_committed_kb >= 32768 OR c_internal_committed_kb >= 49152"),)),
    Rule("compare-nmt-reserved-expansion", "c_non_heap_reserved_kb - b_non_heap_reserved_kb >= 131072 AND c_non_heap_gap_kb - b_non_heap_gap_kb >= 131072 AND abs(c_non_heap_committed_kb - b_non_heap_committed_kb) <= 16384", "MEDIUM", (("HIGH", "c_non_heap_reserved_kb - b_non_heap_reserved_kb >= 262144"),)),
    Rule("compare-nmt-metaspace-growth", "c_metaspace_used_kb - b_metaspace_used_kb >= 8192 OR c_class_committed_kb - b_class_committed_kb >= 8192", "HIGH"),
    Rule("compare-nmt-thread-growth", "c_thread_count - b_thread_count >= 20 OR c_stack_reserved_kb - b_stack_reserved_kb >= 8192", "MEDIUM"),
)

_RSS = "b_rss_available AND c_rss_available"
PMAP = (
    Rule("compare-pmap-growth", f"CASE WHEN {_RSS} THEN c_total_rss_kb - b_total_rss_kb >= 8000 OR c_anon_rss_kb - b_anon_rss_kb >= 8000 ELSE c_total_size_kb - b_total_size_kb > 5000 OR c_anon_size_kb - b_anon_size_kb > 5000 END", "HIGH"),
    Rule("compare-pmap-reserved-expansion", f"{_RSS} AND (c_total_size_kb - b_total_size_kb >= 32000 OR c_anon_size_kb - b_anon_size_kb >= 32000)", "MEDIUM"),
)

#: The columns of a monitor and a pool are those of the strongest change of one (``compare_dumps``), null where none changed for the worse.
THREADS = (
    Rule("compare-thread-dump-deadlock-appeared", "NOT b_deadlock AND c_deadlock", "CRITICAL"),
    Rule("compare-thread-dump-deadlock-resolved", "b_deadlock AND NOT c_deadlock", "LOW"),
    Rule("compare-thread-dump-contention-hotspot", "coalesce(c_monitor_waiters, 0) > 0", "MEDIUM", (("HIGH", "c_monitor_blocked >= 3 OR c_monitor_waiters >= 4"),)),
    Rule("compare-thread-dump-pool-stall", "coalesce(c_pool_threads, 0) > 0", "MEDIUM", (("HIGH", "c_pool_blocked >= 3 OR c_pool_stalled >= 4"),)),
    Rule("compare-thread-dump-blocked-growth", "c_blocked_count - b_blocked_count >= 3 AND (c_blocked_count >= 8 OR (c_blocked_count >= 4 AND 5 * c_blocked_count >= c_thread_count))", "MEDIUM", (("HIGH", "c_blocked_count >= 8"),)),
)

#: Length of both recordings in ms (1 at least), lock events by the minute.
_B_MS, _C_MS = (f"greatest(1.0, ({p}_end_us - {p}_start_us) / 1000.0)" for p in "bc")
_B_RATE, _C_RATE = (f"({p}_lock_count * 60000.0 / {ms})" for p, ms in (("b", _B_MS), ("c", _C_MS)))
JFR = (
    Rule("compare-jfr-lock-contention-regression", f"c_lock_count >= 2 AND ((b_lock_count = 0 AND (c_lock_total_ms >= 250 OR c_lock_max_ms >= 150)) OR (b_lock_count > 0 AND {_C_RATE} >= 1.5 * {_B_RATE} AND {_C_RATE} - {_B_RATE} >= 1) OR (b_lock_total_ms > 0 AND c_lock_total_ms / {_C_MS} >= greatest(0.03, 1.5 * b_lock_total_ms / {_B_MS}) AND c_lock_total_ms / {_C_MS} - b_lock_total_ms / {_B_MS} >= 0.02) OR (b_lock_total_ms > 0 AND c_lock_total_ms >= b_lock_total_ms + 150 AND c_lock_total_ms >= 2 * b_lock_total_ms) OR c_lock_max_ms >= greatest(100, b_lock_max_ms + 50))", "MEDIUM", (("HIGH", f"c_lock_max_ms >= 500 OR c_lock_total_ms >= 1000 OR c_lock_total_ms / {_C_MS} >= 0.10"),)),
    Rule("compare-jfr-gc-pause-regression", f"c_gc_count > 0 AND ((b_gc_count = 0 AND (c_gc_total_ms >= 300 OR c_gc_max_ms >= 200)) OR (b_gc_total_ms > 0 AND c_gc_total_ms / {_C_MS} >= greatest(0.04, 1.5 * b_gc_total_ms / {_B_MS}) AND c_gc_total_ms / {_C_MS} - b_gc_total_ms / {_B_MS} >= 0.02) OR (b_gc_total_ms > 0 AND c_gc_total_ms >= b_gc_total_ms + 250 AND c_gc_total_ms >= 1.5 * b_gc_total_ms) OR c_gc_max_ms >= greatest(250, b_gc_max_ms + 100))", "MEDIUM", (("HIGH", f"c_gc_max_ms >= 1000 OR c_gc_total_ms >= 1500 OR c_gc_total_ms / {_C_MS} >= 0.12"),)),
    Rule("compare-jfr-execution-hot-path-shift", "c_execution_method IS NOT NULL AND c_execution_method_count >= 3 AND c_execution_method_share >= 0.60 AND (b_execution_method IS NULL OR c_execution_method <> b_execution_method OR c_execution_method_share >= b_execution_method_share + 0.20)", "MEDIUM", (("HIGH", "c_execution_method_share >= 0.80 OR c_execution_count >= 8"),)),
    Rule("compare-jfr-allocation-regression", f"c_allocation_count >= 4 AND ((b_allocation_count = 0 AND c_allocation_bytes >= 1000000) OR (b_allocation_bytes > 0 AND c_allocation_bytes >= b_allocation_bytes + 500000 AND c_allocation_bytes / {_C_MS} >= 1.5 * b_allocation_bytes / {_B_MS}) OR (c_allocation_class IS NOT NULL AND NOT c_allocation_class <=> b_allocation_class AND c_allocation_class_share >= 0.60))", "MEDIUM", (("HIGH", "c_allocation_bytes >= 4000000 OR c_allocation_class_share >= 0.80"),)),
    Rule("compare-jfr-old-object-growth", "c_old_object_count >= 2 AND ((b_old_object_count = 0 AND (c_old_object_bytes >= 512000 OR c_max_object_age_ms >= 60000)) OR (b_old_object_bytes > 0 AND c_old_object_bytes >= b_old_object_bytes + 256000 AND c_old_object_bytes >= 1.5 * b_old_object_bytes) OR c_max_object_age_ms >= greatest(60000, b_max_object_age_ms + 60000) OR (c_old_object_class IS NOT NULL AND NOT c_old_object_class <=> b_old_object_class AND c_old_object_class_share >= 0.60))", "MEDIUM", (("HIGH", "c_old_object_bytes >= 2000000 OR c_max_object_age_ms >= 300000 OR c_old_object_count >= 4"),)),
    Rule("compare-jfr-old-object-depth-regression", "c_depth_count > 0 AND ((b_depth_count = 0 AND c_max_reference_depth >= 4) OR c_max_reference_depth >= greatest(4, b_max_reference_depth + 2) OR (c_average_reference_depth >= 2.5 AND c_average_reference_depth >= b_average_reference_depth + 1.0))", "MEDIUM", (("HIGH", "c_max_reference_depth >= 8 OR c_average_reference_depth >= 4.0"),)),
)

BOOKS = {"GC_LOG": GC, "HEAP_HISTOGRAM": HISTOGRAM, "NMT": NMT, "PMAP": PMAP, "JFR": JFR}


def side_by_side(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """For (pair_id, baseline_id, current_id) both summaries as b_ and c_ columns."""
    side = lambda p, key: summary.select(F.col("artifact_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in summary.columns if c != "artifact_id"))
    return pairs.join(side("b", "baseline_id"), "baseline_id").join(side("c", "current_id"), "current_id")


def compare(kind: str, pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """pair_id, finding_id, severity, position."""
    return evaluate(side_by_side(pairs, summary), ["pair_id"], BOOKS[kind])


def compare_histograms(pairs: DataFrame, summary: DataFrame, rows: DataFrame) -> DataFrame:
    """As ``compare``, with the largest growth of a class; classes new in the current histogram grow from 0, vanished ones don't count; of a class that stands twice the row of the last rank counts."""
    cur = pairs.join(rows.withColumnRenamed("artifact_id", "current_id"), "current_id").groupBy("pair_id", "class_name").agg(F.max_by("bytes", "rank").alias("cb"))
    base = pairs.join(rows.withColumnRenamed("artifact_id", "baseline_id"), "baseline_id").groupBy("pair_id", "class_name").agg(F.max_by("bytes", "rank").alias("bb"))
    growth = cur.join(base, ["pair_id", "class_name"], "left").groupBy("pair_id").agg(F.max(F.col("cb") - F.coalesce("bb", F.lit(0))).alias("top_growth_bytes"))
    return evaluate(side_by_side(pairs, summary).join(growth, "pair_id", "left"), ["pair_id"], HISTOGRAM)


def _matched(pairs: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """pair_id, key, b_ and c_ columns: each current row with the baseline's of the same key, 0 where there is none, and whether there is one."""
    cur = pairs.join(rows.select(F.col("artifact_id").alias("current_id"), key, *(F.col(c).alias(f"c_{c}") for c in columns)), "current_id")
    base = rows.select(F.col("artifact_id").alias("baseline_id"), key, F.lit(True).alias("known"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return cur.join(base, ["baseline_id", key], "left").select("pair_id", key, F.coalesce("known", F.lit(False)).alias("known"), *(F.coalesce(f"b_{c}", F.lit(0)).alias(f"b_{c}") for c in columns), *(f"c_{c}" for c in columns))


def monitor_changes(pairs: DataFrame, hotspots: DataFrame) -> DataFrame:
    """pair_id, monitor, known, b_ and c_ waiters and blocked, strongest: monitors that more threads wait for than in the baseline.

    A monitor counts with two blocked threads or three waiting ones, if it is new or has one blocked or two waiting threads more. The strongest
    has the most blocked threads more, then the most blocked, then the most waiting more; ties go to the smaller monitor.
    """
    rows = _matched(pairs, hotspots, "monitor", ["waiters", "blocked"])
    worse = rows.where("(c_blocked >= 2 OR c_waiters >= 3) AND (NOT known OR c_blocked >= b_blocked + 1 OR c_waiters >= b_waiters + 2)")
    order = Window.partitionBy("pair_id").orderBy((F.col("b_blocked") - F.col("c_blocked")), F.desc("c_blocked"), (F.col("b_waiters") - F.col("c_waiters")), "monitor")
    return worse.withColumn("strongest", F.row_number().over(order) == 1)


def pool_changes(pairs: DataFrame, pools: DataFrame) -> DataFrame:
    """pair_id, pool_name, known, b_ and c_ threads, runnable, blocked and stalled, strongest: pools that stall now, or stall more than in the baseline.

    The strongest has the most stalled threads more, then the most blocked; ties go to the smaller name.
    """
    rows = _matched(pairs, pools, "pool_name", ["threads", "runnable", "blocked", "stalled"])
    stalls = lambda p: f"({p}_blocked >= 2 OR ({p}_threads >= 3 AND {p}_runnable = 0 AND {p}_stalled >= 2))"
    worse = rows.where(f"{stalls('c')} AND (NOT {stalls('b')} OR c_stalled >= b_stalled + 2 OR c_blocked >= b_blocked + 2 OR (b_runnable > 0 AND c_runnable = 0 AND c_stalled > b_stalled))")
    order = Window.partitionBy("pair_id").orderBy((F.col("b_stalled") - F.col("c_stalled")), F.desc("c_blocked"), "pool_name")
    return worse.withColumn("strongest", F.row_number().over(order) == 1)


def compare_dumps(pairs: DataFrame, summary: DataFrame, hotspots: DataFrame, pools: DataFrame) -> DataFrame:
    """As ``compare`` for thread dumps, with monitors and pools each held against the same one of the baseline."""
    both = side_by_side(pairs, summary)
    both = both.select(*(c for c in both.columns if not c[2:].startswith(("monitor", "pool"))))
    monitor = monitor_changes(pairs, hotspots).where("strongest").select("pair_id", *(F.col(f"{p}_{c}").alias(f"{p}_monitor_{c}") for p in "bc" for c in ("waiters", "blocked")))
    pool = pool_changes(pairs, pools).where("strongest").select("pair_id", *(F.col(f"{p}_{c}").alias(f"{p}_pool_{c}") for p in "bc" for c in ("threads", "runnable", "blocked", "stalled")))
    return evaluate(both.join(monitor, "pair_id", "left").join(pool, "pair_id", "left"), ["pair_id"], THREADS)


def sequence(findings: DataFrame, keys: list[str], step: str) -> DataFrame:
    """First wins by finding id over steps: the whole span (step 0) before the neighbouring pairs in order."""
    best = findings.groupBy(*keys, "finding_id").agg(F.min(F.struct(step, "position", "severity")).alias("b"))
    return best.select(*keys, "finding_id", F.col("b.severity").alias("severity"), F.col(f"b.{step}").alias(step))
