"""Rules for one artifact of each kind. Conditions and severities are fixed values; columns are those of the parsers' summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heapstone.operators.rules import Rule, evaluate

CONTAINER = (
    Rule("container-memory-limit-pressure", "max_defined AND max_bytes > 0 AND (usage_of_max_ratio >= 0.90 OR headroom_to_max_bytes <= 67108864 OR max_events > 0)", "HIGH", (("CRITICAL", "usage_of_max_ratio >= 0.98 OR headroom_to_max_bytes <= 16777216 OR oom_events > 0 OR oom_kill_events > 0"),)),
    Rule("container-memory-high-pressure", "high_defined AND high_bytes > 0 AND (usage_of_high_ratio >= 1.0 OR high_events > 0)", "MEDIUM", (("HIGH", "usage_of_high_ratio >= 1.10 OR high_events >= 50 OR memory_full_avg10 >= 0.10"),)),
    Rule("container-memory-oom-events", "oom_events > 0 OR oom_kill_events > 0", "CRITICAL"),
    Rule("container-memory-reclaim-stalls", "memory_some_avg10 >= 1.0 OR memory_some_avg60 >= 0.5 OR memory_full_avg10 >= 0.10 OR memory_full_avg60 >= 0.05", "MEDIUM", (("HIGH", "memory_full_avg10 >= 0.50 OR memory_some_avg10 >= 5.0"),)),
    Rule("container-cpu-quota-or-processor-mis-sizing", "(cpu_ceiling_cores > 0 AND cpu_ceiling_cores <= 1.0) OR throttled > 0 AND (throttled_ratio >= 0.10 OR throttled_ms >= 1000) OR cpu_some_avg10 >= 1.0 OR cpu_full_avg10 >= 0.05", "MEDIUM", (("HIGH", "throttled_ratio >= 0.25 OR throttled_ms >= 5000 OR cpu_full_avg10 >= 0.10 OR cpu_ceiling_cores > 0 AND cpu_ceiling_cores <= 0.5"),)),
)

GC = (
    Rule("gc-repeated-full-gcs", "full_gc_count >= 3 AND max_full_gc_pause_ms >= 200", "CRITICAL"),
    Rule("gc-heap-saturation", "peak_occupancy_ratio >= 0.95", "HIGH"),
    Rule("gc-pause-latency", "pause_count >= 3 AND full_gc_count = 0 AND (p95_pause_ms >= 100 OR average_pause_ms >= 100)", "MEDIUM"),
    Rule("gc-g1-humongous-pressure", "collector = 'G1' AND humongous_sample_count >= 2 AND peak_humongous_after >= 12 AND (humongous_growth_count >= 2 OR humongous_max_growth >= 4) AND (peak_occupancy_ratio >= 0.85 OR p95_pause_ms >= 75 OR full_gc_count >= 1 OR evacuation_failure_pause_count >= 1)", "MEDIUM", (("HIGH", "(peak_humongous_after >= 128 AND peak_occupancy_ratio >= 0.95) OR to_space_exhausted_count >= 1 OR evacuation_failure_pause_count >= 1"),)),
    Rule("gc-allocation-stall-pressure", "allocation_stall_count >= 3 AND (max_allocation_stall_ms >= 5 OR total_allocation_stall_ms >= 20)", "MEDIUM", (("HIGH", "allocation_stall_count >= 10 OR max_allocation_stall_ms >= 10 OR total_allocation_stall_ms >= 100 OR stop_the_world_pct >= 10"),)),
    Rule("gc-g1-evacuation-failure-distress", "evacuation_failure_pause_count >= 1 AND (to_space_exhausted_count >= 1 OR full_compaction_attempt_count >= 1)", "HIGH", (("CRITICAL", "to_space_exhausted_count >= 1 OR full_compaction_attempt_count >= 2 OR peak_occupancy_ratio >= 0.98"),)),
    Rule("gc-cms-promotion-failure", "collector = 'CMS' AND promotion_failed_count >= 1", "MEDIUM", (("HIGH", "promotion_failed_count >= 2 OR full_gc_count >= 2 OR peak_occupancy_ratio >= 0.95 OR concurrent_mode_failure_count >= 1"),)),
    Rule("gc-metaspace-full-gcs", "metaspace_full_gc_count >= 2 OR (metaspace_full_gc_count >= 1 AND peak_metaspace_usage_ratio >= 0.80)", "MEDIUM", (("HIGH", "metaspace_full_gc_count >= 4 OR peak_metaspace_usage_ratio >= 0.85"),)),
)

HISTOGRAM = (
    Rule("histogram-top-heavy-consumer", "top_consumer_total_share >= 0.30 OR (top_consumer_visible_share >= 0.45 AND top_consumer_bytes >= 8000000 AND visible_bytes >= 12000000)", "MEDIUM"),
    Rule("histogram-cache-retention", "cache_like_bytes >= 2000000 OR cache_like_instances >= 20000", "MEDIUM", (("HIGH", "cache_like_bytes >= 8000000 OR cache_like_instances >= 75000"),)),
    Rule("histogram-collection-retention", "collection_like_bytes >= 4000000 OR collection_like_instances >= 50000 OR entry_like_instances >= 25000", "MEDIUM"),
    Rule("histogram-payload-retention", "payload_like_bytes >= 8000000 OR payload_like_instances >= 150000", "MEDIUM"),
)

CRASH = (
    Rule("hs-err-native-thread-exhaustion", "crash_type = 'native_thread_exhaustion'", "CRITICAL"),
    Rule("hs-err-native-allocation-failure", "crash_type = 'native_allocation_failure'", "CRITICAL"),
    Rule("hs-err-compiler-thread-native-oom", "crash_type = 'native_allocation_failure' AND current_thread_name LIKE '%CompilerThread%'", "HIGH"),
    Rule("hs-err-compressed-class-space-oom", "crash_type = 'compressed_class_space_oom'", "CRITICAL"),
    Rule("hs-err-code-cache-full", "crash_type = 'code_cache_full' OR code_cache_full", "HIGH", (("CRITICAL", "trim(coalesce(signal, '')) <> ''"),)),
    Rule("hs-err-fatal-signal", "trim(coalesce(signal, '')) <> ''", "CRITICAL"),
    Rule("hs-err-g1-fullgc-crash", "problem_frame LIKE '%G1FullGCMarker%'", "HIGH"),
)

JFR = (
    Rule("jfr-lock-contention-events", "lock_count > 0 AND (lock_max_ms >= 100 OR lock_total_ms >= 500 OR lock_count >= 5)", "MEDIUM", (("HIGH", "lock_max_ms >= 1000 OR lock_total_ms >= 5000 OR lock_count >= 20"),)),
    Rule("jfr-gc-pause-events", "gc_count > 0 AND (gc_max_ms >= 200 OR gc_total_ms >= 1000)", "MEDIUM", (("HIGH", "gc_max_ms >= 1000 OR gc_total_ms >= 5000"),)),
    Rule("jfr-monitor-wait-events", "monitor_wait_count > 0 AND (monitor_wait_max_ms >= 100 OR monitor_wait_total_ms >= 400 OR monitor_wait_count >= 4)", "MEDIUM", (("HIGH", "monitor_wait_max_ms >= 1000 OR monitor_wait_total_ms >= 3000 OR monitor_wait_count >= 12"),)),
    Rule("jfr-thread-park-events", "thread_park_count > 0 AND (thread_park_max_ms >= 100 OR thread_park_total_ms >= 300 OR thread_park_count >= 10)", "MEDIUM", (("HIGH", "thread_park_max_ms >= 1000 OR thread_park_total_ms >= 3000 OR thread_park_count >= 50"),)),
    Rule("jfr-io-latency-events", "io_count > 0 AND (io_max_ms >= 100 OR io_total_ms >= 300 OR io_count >= 5)", "MEDIUM", (("HIGH", "io_max_ms >= 1000 OR io_total_ms >= 3000 OR io_count >= 20"),)),
    Rule("jfr-virtual-thread-pinning", "pinned_count > 0", "MEDIUM", (("HIGH", "pinned_count >= 3 OR virtual_thread_max_ms >= 100"),)),
    Rule("jfr-virtual-thread-submit-failed", "submit_failed_count > 0", "MEDIUM", (("HIGH", "submit_failed_count >= 3"),)),
    Rule("jfr-exception-burst", "exception_count >= 20", "MEDIUM", (("HIGH", "exception_count >= 100"),)),
    Rule("jfr-safepoint-pause-events", "safepoint_count > 0 AND (safepoint_max_ms >= 50 OR safepoint_total_ms >= 200 OR safepoint_count >= 5)", "MEDIUM", (("HIGH", "safepoint_max_ms >= 500 OR safepoint_total_ms >= 1500"),)),
    Rule("jfr-class-loading-pressure", "class_loading_count >= 5 AND (class_loading_count >= 10 OR class_loading_bytes >= 1000000)", "MEDIUM", (("HIGH", "class_loading_count >= 20 OR class_loading_bytes >= 2000000"),)),
    Rule("jfr-code-cache-pressure", "code_cache_count > 0 AND code_cache_full_count > 0", "MEDIUM", (("HIGH", "code_cache_full_count > 0"),)),
    Rule("jfr-cpu-load-saturation", "cpu_load_count > 0 AND (peak_machine_total >= 0.90 OR average_machine_total >= 0.75 OR peak_jvm_total >= 0.80)", "MEDIUM", (("HIGH", "peak_machine_total >= 0.97 OR average_machine_total >= 0.85 OR peak_jvm_total >= 0.90"),)),
    Rule("jfr-execution-hot-path", "execution_count >= 5 AND execution_method_count >= 3 AND execution_method_share >= 0.60 AND execution_method IS NOT NULL", "MEDIUM", (("HIGH", "execution_count >= 10 OR execution_method_share >= 0.80"),)),
    Rule("jfr-runtime-hot-path", "runtime_method_count >= 2 AND runtime_method_share >= 0.50 AND runtime_method IS NOT NULL AND lock_count + thread_park_count + monitor_wait_count + io_count >= 3", "MEDIUM", (("HIGH", "lock_count + thread_park_count + monitor_wait_count + io_count >= 6 OR runtime_method_share >= 0.75"),)),
    Rule("jfr-allocation-churn", "allocation_count >= 5 AND (allocation_bytes >= 8000000 OR allocation_max_bytes >= 1000000 OR allocation_class_count >= 5)", "MEDIUM", (("HIGH", "allocation_bytes >= 16000000 OR allocation_class_byte_share >= 0.80 OR allocation_count >= 10"),)),
    Rule("jfr-dominant-allocation-class", "allocation_class IS NOT NULL AND allocation_class_count >= 4 AND (allocation_class_share >= 0.60 OR allocation_class_byte_share >= 0.60)", "MEDIUM", (("HIGH", "allocation_class_share >= 0.80 OR allocation_class_byte_share >= 0.80"),)),
    Rule("jfr-allocation-hot-path", "allocation_count >= 5 AND allocation_method_count >= 3 AND (allocation_method_share >= 0.60 OR allocation_method_byte_share >= 0.60) AND allocation_method IS NOT NULL", "MEDIUM", (("HIGH", "allocation_count >= 8 OR allocation_method_share >= 0.80 OR allocation_method_byte_share >= 0.80"),)),
    Rule("jfr-old-object-retention-candidates", "old_object_count >= 2 AND (old_object_bytes >= 512000 OR max_object_age_ms >= 60000 OR max_reference_depth >= 4)", "MEDIUM", (("HIGH", "old_object_bytes >= 2000000 OR max_object_age_ms >= 300000 OR max_reference_depth >= 6"),)),
    Rule("jfr-dominant-old-object-class", "old_object_class IS NOT NULL AND old_object_class_count >= 2 AND (old_object_class_share >= 0.60 OR old_object_class_byte_share >= 0.60)", "MEDIUM", (("HIGH", "old_object_class_share >= 0.80 OR old_object_class_byte_share >= 0.80"),)),
    Rule("jfr-old-object-reference-depth", "depth_count > 0 AND (max_reference_depth >= 4 OR average_reference_depth >= 2.5)", "MEDIUM", (("HIGH", "max_reference_depth >= 8 OR average_reference_depth >= 4.0"),)),
)

NMT = (
    Rule("nmt-native-allocation-growth", "committed_delta_kb >= 16384", "MEDIUM", (("HIGH", "committed_delta_kb >= 65536"),)),
    Rule("nmt-internal-arena-growth", "(internal_committed_delta_kb >= 16384 AND (internal_committed_delta_kb >= 0.35 * committed_delta_kb OR internal_committed_delta_kb >= 24576)) OR (snapshot_kind <> 'diff' AND internal_committed_kb >= 32768 AND internal_committed_kb >= 0.20 * committed_kb)", "MEDIUM", (("HIGH", "internal_committed_delta_kb >= 32768 OR internal_committed_kb >= 49152 OR internal_committed_kb >= 0.35 * committed_kb"),)),
    Rule("nmt-reserved-committed-mismatch", "non_heap_reserved_kb >= 262144 AND non_heap_gap_kb >= 196608 AND non_heap_committed_kb > 0 AND non_heap_commit_ratio <= 0.25", "MEDIUM"),
    Rule("nmt-metaspace-pressure", "metaspace_committed_kb > 0 AND metaspace_used_kb / metaspace_committed_kb >= 0.85", "HIGH"),
    Rule("nmt-compressed-class-space-pressure", "(class_space_committed_kb > 0 AND class_space_used_kb / class_space_committed_kb >= 0.90) OR (class_space_reserved_kb > 0 AND class_space_used_kb / class_space_reserved_kb >= 0.85) OR class_space_used_delta_kb >= 4096", "MEDIUM", (("HIGH", "(class_space_committed_kb > 0 AND class_space_used_kb / class_space_committed_kb >= 0.97) OR (class_space_reserved_kb > 0 AND class_space_used_kb / class_space_reserved_kb >= 0.95)"),)),
    Rule("nmt-class-metadata-growth", "snapshot_kind = 'diff' AND (class_count_delta >= 5000 OR class_committed_delta_kb >= 8192 OR metaspace_used_delta_kb >= 8192)", "MEDIUM", (("HIGH", "class_count_delta >= 20000 OR class_committed_delta_kb >= 16384 OR metaspace_used_delta_kb >= 16384"),)),
    Rule("nmt-code-cache-pressure", "code_committed_kb >= 16384 OR code_committed_delta_kb >= 8192", "MEDIUM", (("HIGH", "code_committed_kb >= 32768 OR code_committed_delta_kb >= 16384"),)),
    Rule("nmt-gc-native-pressure", "gc_committed_kb >= 32768", "MEDIUM"),
    Rule("nmt-thread-stack-pressure", "thread_count > 100 OR stack_reserved_kb >= 32768", "MEDIUM"),
)

OOM = (
    Rule("oom-signal-kernel-oom-kill", "kernel_oom_kill_count > 0", "CRITICAL"),
    Rule("oom-signal-pod-oomkilled", "pod_oom_killed_count > 0", "CRITICAL"),
    Rule("oom-signal-restart-loop", "crash_loop_count > 0 AND max_restart_count >= 3", "HIGH", (("CRITICAL", "max_restart_count >= 5"),)),
)

PMAP = (
    Rule("pmap-anon-pressure", "anon_virtual_share >= 0.70", "MEDIUM", (("HIGH", "anon_virtual_share >= 0.85 OR (rss_available AND anon_resident_share >= 0.60)"),)),
    Rule("pmap-virtual-resident-mismatch", "rss_available AND anon_virtual_share >= 0.85 AND anon_resident_ratio <= 0.15 AND reserved_gap_ratio >= 0.80", "MEDIUM"),
)

THREADS = (
    Rule("thread-dump-java-deadlock", "deadlock", "CRITICAL"),
    Rule("thread-dump-lock-contention-hotspot", "monitor_blocked >= 2 OR monitor_waiters >= 3", "MEDIUM", (("HIGH", "monitor_blocked >= 3"),)),
    Rule("thread-dump-stuck-thread-pool", "pool_blocked >= 2 OR (pool_threads >= 3 AND pool_runnable = 0 AND pool_stalled >= 2)", "MEDIUM", (("HIGH", "pool_blocked >= 3 OR pool_stalled >= 3"),)),
    Rule("thread-dump-downstream-io-pileup", "io_threads >= 2 AND io_pool_runnable = 0", "MEDIUM", (("HIGH", "io_threads >= 3"),)),
    Rule("thread-dump-forkjoin-starvation", "join_threads >= 2 AND join_pool_runnable = 0", "MEDIUM", (("HIGH", "join_threads >= 3"),)),
    Rule("thread-dump-virtual-thread-pinning", "pinned_count >= 1", "MEDIUM", (("HIGH", "pinned_count >= 2"),)),
    Rule("thread-dump-busy-spin-thread", "spin_share >= 0.80", "MEDIUM", (("HIGH", "spin_share >= 0.95 OR spin_cpu_ms >= 10000"),)),
)

BOOKS = {"CONTAINER_MEMORY": CONTAINER, "GC_LOG": GC, "HEAP_HISTOGRAM": HISTOGRAM, "HS_ERR_LOG": CRASH, "JFR": JFR, "NMT": NMT, "OOM_SIGNAL": OOM, "PMAP": PMAP, "THREAD_DUMP": THREADS}


def assess(kind: str, summary: DataFrame, keys: tuple[str, ...] = ("artifact_id",)) -> DataFrame:
    """keys, finding_id, severity, position of one kind of artifact."""
    return evaluate(summary, list(keys), BOOKS[kind])
