"""Cross-artifact alignments: what families of signals each artifact shows, whose identities and clocks meet, and how much that counts.

An incident is one wide row: for each kind of artifact its families (null where the incident has none of that kind), arrays of identities, and
the status of each pair of clocks. Alignments are a table of expressions over that row; one scan gives all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators import compare

#: Families of signals by kind of artifact, with their conditions on the summary's columns.
FAMILIES = {
    "JFR": (
        ("lock-contention", "lock_count > 0 AND (lock_max_ms >= 75 OR lock_total_ms >= 150)"),
        ("gc-distress", "gc_count > 0 AND (gc_max_ms >= 150 OR gc_total_ms >= 300)"),
        ("allocation-pressure", "allocation_count > 0 AND (allocation_bytes >= 8000000 OR allocation_max_bytes >= 1000000 OR allocation_class_count >= 4)"),
        ("retention-pressure", "old_object_count > 0 AND (old_object_bytes >= 512000 OR max_object_age_ms >= 60000 OR max_reference_depth >= 4)"),
        ("class-loading-pressure", "class_loading_count > 0 AND (class_loading_count >= 5 OR class_loading_bytes >= 1000000)"),
        ("code-cache-pressure", "code_cache_full_count > 0"),
    ),
    "GC_LOG": (
        ("gc-distress", "full_gc_count > 0 OR allocation_stall_count > 0 OR p95_pause_ms >= 100 OR max_full_gc_pause_ms >= 200"),
        ("heap-pressure", "peak_post_gc_occupancy_ratio >= 0.90 OR near_capacity_count > 0"),
        ("metaspace-pressure", "metaspace_full_gc_count > 0 OR peak_metaspace_usage_ratio >= 0.80"),
    ),
    "THREAD_DUMP": (("lock-contention", "deadlock OR blocked_count > 0 OR monitor_blocked >= 2"), ("thread-pool-pressure", "pool_blocked >= 2")),
    "HEAP_HISTOGRAM": (("retention-pressure", "payload_like_bytes >= 8000000 OR collection_like_bytes >= 4000000 OR cache_like_bytes >= 2000000 OR top_consumer_total_share >= 0.30"),),
    "HS_ERR_LOG": (
        ("crash-distress", "signal IS NOT NULL OR crash_type IN ('native_allocation_failure', 'native_thread_exhaustion', 'compressed_class_space_oom', 'code_cache_full')"),
        ("native-pressure", "crash_type IN ('native_allocation_failure', 'native_thread_exhaustion', 'compressed_class_space_oom', 'code_cache_full')"),
        ("thread-pressure", "crash_type = 'native_thread_exhaustion'"),
        ("compressed-class-space-pressure", "crash_type = 'compressed_class_space_oom'"),
        ("code-cache-pressure", "code_cache_full"),
        ("gc-distress", "problem_symbol LIKE '%FullGC%'"),
    ),
    "NMT": (
        ("native-pressure", "committed_delta_kb >= 16384 OR stack_reserved_kb >= 32768 OR gc_committed_kb >= 32768 OR (class_space_committed_kb > 0 AND class_space_used_kb / class_space_committed_kb >= 0.90) OR (class_space_reserved_kb > 0 AND class_space_used_kb / class_space_reserved_kb >= 0.85) OR class_space_used_delta_kb >= 4096"),
        ("metaspace-pressure", "(metaspace_committed_kb > 0 AND metaspace_used_kb / metaspace_committed_kb >= 0.85) OR metaspace_used_delta_kb >= 8192 OR class_committed_delta_kb >= 8192 OR class_count_delta >= 5000"),
        ("compressed-class-space-pressure", "(class_space_committed_kb > 0 AND class_space_used_kb / class_space_committed_kb >= 0.90) OR (class_space_reserved_kb > 0 AND class_space_used_kb / class_space_reserved_kb >= 0.85) OR class_space_used_delta_kb >= 4096"),
        ("code-cache-pressure", "code_committed_kb >= 16384 OR code_committed_delta_kb >= 8192"),
        ("thread-pressure", "thread_count > 100 OR stack_reserved_kb >= 32768 OR stack_reserved_delta_kb >= 16384"),
        ("reservation-mismatch", "non_heap_reserved_kb >= 262144 AND non_heap_gap_kb >= 196608 AND non_heap_committed_kb > 0 AND non_heap_commit_ratio <= 0.25"),
    ),
    "PMAP": (("native-pressure", "anon_virtual_share >= 0.70 OR anon_resident_share >= 0.60 OR anon_size_kb >= 262144"), ("reservation-mismatch", "anon_virtual_share >= 0.85 AND anon_resident_ratio <= 0.15 AND reserved_gap_ratio >= 0.80")),
    "CONTAINER_MEMORY": (("container-pressure", "usage_of_max_ratio >= 0.90 OR high_events > 0 OR memory_full_avg10 >= 1.0 OR memory_some_avg10 >= 1.0"), ("oom-termination", "oom_kill_events > 0 OR oom_events > 0")),
    "OOM_SIGNAL": (("oom-termination", "kernel_oom_kill_count > 0 OR pod_oom_killed_count > 0"), ("restart-pressure", "crash_loop_count > 0 OR max_restart_count > 0")),
}
#: Names of the kinds' columns in an incident's row.
SHORT = {"JFR": "jfr", "GC_LOG": "gc", "THREAD_DUMP": "dump", "HEAP_HISTOGRAM": "heap", "HS_ERR_LOG": "crash", "NMT": "nmt", "PMAP": "pmap", "CONTAINER_MEMORY": "container", "OOM_SIGNAL": "oom"}
#: Identities that two artifacts may share: an array for each side, and how many of them join at most.
IDENTITIES = {"threads": 6, "pools": 4, "frames": 5, "locks": 6, "classes": 5, "groups": 4}
#: Pairs of clocks whose status alignments read.
CLOCKS = ("jfr_gc", "dump", "heap", "nmt", "dump_nmt", "nmt_pmap", "crash_native", "container_oom")
#: Tolerances of clocks in microseconds: half an hour for crash logs, a quarter for others.
TOLERANCE_US = {"crash_native": 30 * 60_000_000, "dump_nmt": 15 * 60_000_000, "nmt_pmap": 15 * 60_000_000, "container_oom": 15 * 60_000_000}
MOST = 10

OVERLAP, NEARBY, APART, NO_CLOCK = (x[0] for x in (compare.OVERLAP, compare.NEARBY, compare.APART, compare.NO_CLOCK))


def families(kind: str, summary: DataFrame) -> DataFrame:
    """artifact_id, families: what an artifact's summary shows, in the table's order."""
    shown = F.array(*(F.when(F.expr(condition), F.lit(name)) for name, condition in FAMILIES[kind]))
    return summary.select("artifact_id", F.filter(shown, lambda x: x.isNotNull()).alias("families"))


def first_of_each_kind(profiles: DataFrame, incident: list[str]) -> DataFrame:
    """One row an incident with ``<kind>_families``: only the first artifact of each kind (by name) takes part. profiles: incident, kind, artifact_id, families."""
    firsts = profiles.groupBy(*incident, "kind").agg(F.min_by("families", "artifact_id").alias("f"))
    return firsts.groupBy(*incident).agg(*(F.max(F.when(F.col("kind") == kind, F.col("f"))).alias(f"{name}_families") for kind, name in SHORT.items()))


# --- identities ---


def pool_of(thread: Column) -> Column:
    """A thread's name without its trailing number; null where it has none."""
    base = F.regexp_extract(thread, r"^(.+?)-\d+$", 1)
    return F.when(base != "", base)


def method_of(frame: Column) -> Column:
    """The method of a frame as dumps or recordings write it, without source and arguments."""
    return F.regexp_replace(F.regexp_replace(F.trim(frame), r"^at\s+", ""), r"[\(\s].*$", "")


def lock_key(text: Column) -> Column:
    """The first hexadecimal address, in lower case; null without one."""
    key = F.lower(F.regexp_extract(text, r"0x[0-9a-fA-F]+", 0))
    return F.when(key != "", key)


def joined(values: Column, most: int) -> Column:
    """Distinct non-blank values in order of appearance, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), 1, most)


def merge(*arrays: Column) -> Column:
    """Distinct values of several arrays in order."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


# --- clocks ---


def clock_status(windows_a: DataFrame, windows_b: DataFrame, incident: list[str], name: str) -> DataFrame:
    """incident, status of two artifacts' windows (start_us, end_us): overlap of any pair, else the nearest gap within the clock's tolerance, else apart.

    Where one side has no window there is no shared clock. Only the few windows of an incident meet.
    """
    side = lambda df, p: df.select(*incident, F.col("start_us").alias(f"{p}_lo"), F.col("end_us").alias(f"{p}_hi"))
    pairs = side(windows_a, "a").join(side(windows_b, "b"), incident, "full_outer")
    gap = F.greatest(F.col("b_lo") - F.col("a_hi"), F.col("a_lo") - F.col("b_hi"))
    known = F.col("a_lo").isNotNull() & F.col("b_lo").isNotNull()
    nearest = pairs.groupBy(*incident).agg(F.min(F.when(known, gap)).alias("gap"))
    status = F.when(F.col("gap").isNull(), NO_CLOCK).when(F.col("gap") <= 0, OVERLAP).when(F.col("gap") <= TOLERANCE_US.get(name, 0), NEARBY).otherwise(APART)
    return nearest.select(*incident, status.alias(f"t_{name}"))


# --- alignments ---


def _has(kind: str, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(f"{kind}_families"), F.array(*map(F.lit, names))), F.lit(False))


def _shared(a: str, b: str, what: str) -> Column:
    return F.coalesce(F.size(F.array_intersect(F.slice(F.coalesce(f"{a}_{what}", F.array().cast("array<string>")), 1, IDENTITIES[what]), F.slice(F.coalesce(f"{b}_{what}", F.array().cast("array<string>")), 1, IDENTITIES[what]))) > 0, F.lit(False))


def _at(clock: str, status: str) -> Column:
    return F.coalesce(F.col(f"t_{clock}") == status, F.lit(False))


def _plus(test: Column, points: int) -> Column:
    return F.when(test, points).otherwise(0)


def _timed(score: Column, clock: str, overlap: int, nearby: int = 0, apart: int = 0, floor: int = 58) -> Column:
    """A score with what its clock adds or takes."""
    out = F.when(_at(clock, OVERLAP), score + overlap)
    if nearby:
        out = out.when(_at(clock, NEARBY), score + nearby)
    if apart:
        out = out.when(_at(clock, APART), F.greatest(F.lit(floor), score - apart))
    return out.otherwise(score)


def _contention() -> Column:
    return F.lit(84) + _plus(_shared("jfr", "dump", "threads"), 6) + _plus(_shared("jfr", "dump", "pools"), 4) + _plus(_shared("jfr", "dump", "frames"), 4) + _plus(_shared("jfr", "dump", "locks"), 4)


def _metaspace() -> Column:
    base = F.when(_has("gc", "metaspace-pressure"), 82).otherwise(76)
    return F.when(_at("jfr_gc", OVERLAP), base + 8).when(_at("jfr_gc", APART), base - 4).when(_at("nmt", OVERLAP), base + 4).when(_at("nmt", APART), base - 2).otherwise(base)


def _code_cache() -> Column:
    crash, nmt = _has("crash", "code-cache-pressure"), _has("nmt", "code-cache-pressure")
    base = F.when(crash & nmt, 86).when(crash, 80).otherwise(76)
    return base + F.when(_at("nmt", OVERLAP), 4).when(_at("nmt", APART), -2).otherwise(0) + _plus(_at("crash_native", NEARBY), 2)


def _heap_classes() -> Column:
    return _timed(F.when(_shared("jfr", "heap", "classes"), 90).otherwise(75), "heap", 8, 0, 12)


def _native() -> Column:
    return F.col("nmt_families").isNotNull() | F.col("pmap_families").isNotNull()


HEAP_SIDE = ("gc-distress", "allocation-pressure", "retention-pressure")

#: Alignments: id, condition, score. Base scores and points are fixed values.
ALIGNMENTS: tuple[tuple[str, Callable[[], Column], Callable[[], Column]], ...] = (
    ("jfr-gc-pressure-alignment", lambda: _has("gc", "gc-distress") & _has("jfr", *HEAP_SIDE), lambda: _timed(F.lit(80), "jfr_gc", 8)),
    ("jfr-metaspace-class-pressure-alignment", lambda: _has("jfr", "class-loading-pressure") & _has("nmt", "metaspace-pressure"), _metaspace),
    ("jfr-code-cache-pressure-alignment", lambda: _has("jfr", "code-cache-pressure") & (_has("crash", "code-cache-pressure") | _has("nmt", "code-cache-pressure")), _code_cache),
    ("jfr-thread-dump-contention-alignment", lambda: _has("jfr", "lock-contention") & _has("dump", "lock-contention"), lambda: _timed(_contention(), "dump", 8, 0, 12)),
    ("jfr-heap-class-overlap", lambda: _shared("jfr", "heap", "classes") | _shared("jfr", "heap", "groups"), _heap_classes),
    ("thread-dump-nmt-thread-pressure-alignment", lambda: _has("dump", "thread-pool-pressure", "lock-contention") & _has("nmt", "thread-pressure"), lambda: _timed(F.lit(82) + _plus(F.coalesce("dump_blocked_pools", F.lit(False)), 4) + _plus(_has("dump", "lock-contention"), 3), "dump_nmt", 8, 4, 12)),
    ("nmt-pmap-reservation-mismatch-alignment", lambda: _has("nmt", "reservation-mismatch") & _has("pmap", "reservation-mismatch"), lambda: _timed(F.lit(84) + _plus(F.coalesce("nmt_gap_categories", F.lit(False)), 3), "nmt_pmap", 8, 4, 12)),
    ("hs-err-native-pressure-alignment", lambda: _has("crash", "native-pressure") & (_has("nmt", "native-pressure") | _has("pmap", "native-pressure")), lambda: _timed(F.lit(82) + _plus(_has("nmt", "native-pressure") & _has("pmap", "native-pressure"), 4), "crash_native", 8, 5, 10, 56)),
    ("compressed-class-space-pressure-alignment", lambda: _has("crash", "compressed-class-space-pressure") & _has("nmt", "compressed-class-space-pressure"), lambda: _timed(F.lit(88), "crash_native", 6, 4, 10, 68)),
    ("container-oom-pressure-alignment", lambda: _has("container", "container-pressure") & _has("oom", "oom-termination"), lambda: _timed(F.lit(88), "container_oom", 8, 5, 14)),
    ("jfr-gc-heap-pressure-alignment", lambda: _has("gc", "gc-distress") & _has("heap", "retention-pressure") & _has("jfr", "allocation-pressure", "retention-pressure") & ~_at("jfr_gc", APART) & ~_at("heap", APART), lambda: F.when(_shared("jfr", "heap", "classes"), 100).otherwise(92) + _plus(_at("jfr_gc", OVERLAP), 5) + _plus(_at("heap", OVERLAP), 4)),
    ("jfr-native-pressure-alignment", lambda: _native() & _has("jfr", *HEAP_SIDE), lambda: _timed(F.when(F.col("gc_families").isNotNull(), 72).otherwise(68), "nmt", 8, 0, 8, 56)),
)


def alignments(incidents: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """keys, alignment, score, position: what holds for each incident, by falling score, then name; at most ``most``.

    ``incidents``: keys, ``<kind>_families``, ``<kind>_<identity>`` arrays of jfr, dump and heap, ``t_<clock>`` statuses; columns that are missing count as null.
    """
    wide = incidents
    texts = [*(f"{k}_families" for k in SHORT.values()), *(f"{k}_{what}" for k in ("jfr", "dump", "heap") for what in IDENTITIES)]
    for name, kind in [*((t, "array<string>") for t in texts), *((f"t_{c}", "string") for c in CLOCKS), ("dump_blocked_pools", "boolean"), ("nmt_gap_categories", "boolean")]:
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast(kind))
    found = F.array(*(F.when(test(), F.struct(F.lit(name).alias("alignment"), score().cast("int").alias("score"))) for name, test, score in ALIGNMENTS))
    rows = wide.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(*keys, "a.*")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "alignment")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def as_findings(found: DataFrame, incidents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finding_id as correlation rules read them: ``align:<name>`` for each alignment, ``apart:<name>`` for clocks that exclude each other.

    Clocks that are not shared prove nothing and give no row.
    """
    names = {"jfr_gc": "jfr-gc", "dump": "jfr-thread-dump", "heap": "heap", "dump_nmt": "thread-dump-nmt", "nmt_pmap": "nmt-pmap", "crash_native": "hs-err-native", "container_oom": "container-oom"}
    aligned = found.select(*keys, F.concat(F.lit("align:"), F.regexp_replace("alignment", "-alignment$", "")).alias("finding_id"))
    there = [F.when(_at(clock, APART), F.lit(f"apart:{name}")) for clock, name in names.items() if f"t_{clock}" in incidents.columns]
    if not there:
        return aligned
    apart = incidents.select(*keys, F.explode(F.filter(F.array(*there), lambda x: x.isNotNull())).alias("finding_id"))
    return aligned.unionByName(apart)
