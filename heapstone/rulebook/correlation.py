"""Rules over the findings of several artifacts of one incident, in order: a later rule sees what earlier ones emitted.

Alignments in time enter as finding ids too: ``align:<name>`` where two artifacts' signals meet, ``apart:<name>`` where their clocks exclude it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.operators import compare
from heapstone.operators.rules import Staged, correlate

# Groups of findings.
_GC = ("gc-repeated-full-gcs", "gc-allocation-stall-pressure")
_PMAP = ("pmap-anon-pressure", "pmap-virtual-resident-mismatch")
_HISTOGRAM = ("histogram-cache-retention", "histogram-collection-retention", "histogram-payload-retention")
_ALLOCATION = ("jfr-allocation-churn", "jfr-dominant-allocation-class", "jfr-allocation-hot-path")
_RETENTION = ("jfr-old-object-retention-candidates", "jfr-dominant-old-object-class", "jfr-old-object-reference-depth")
_CONTAINER = ("container-memory-limit-pressure", "container-memory-high-pressure", "container-memory-oom-events", "container-memory-reclaim-stalls")
_OOM = ("oom-signal-kernel-oom-kill", "oom-signal-pod-oomkilled", "oom-signal-restart-loop")
_NMT = ("nmt-gc-native-pressure", "nmt-native-allocation-growth", "nmt-thread-stack-pressure", "nmt-metaspace-pressure", "nmt-code-cache-pressure", "nmt-class-metadata-growth")
_STUCK = ("thread-dump-stuck-thread-pool", "thread-dump-lock-contention-hotspot")
_META = ("nmt-metaspace-pressure", "nmt-class-metadata-growth", "compare-nmt-metaspace-growth")
_APART_DUMP = ("apart:jfr-thread-dump",)
_ACTIVE = ("nmt-native-allocation-growth", "compare-nmt-native-growth", "compare-pmap-growth", "nmt-thread-stack-pressure", "nmt-metaspace-pressure", "nmt-code-cache-pressure")

# States that rules combine, told before they run: whether native pressure goes beyond reservations, whether recordings show heap-side signals.
STATES = (
    Staged("state:native-pressure-open", (), "", (), ("nmt-reserved-committed-mismatch",), False),
    Staged("state:native-pressure-open", (), "", (), ("pmap-virtual-resident-mismatch",), False),
    Staged("state:native-pressure-open", (_ACTIVE,), "", shown=False),
    Staged("state:jfr-heap-side", (_RETENTION,), "", shown=False),
    Staged("state:jfr-heap-side", (_ALLOCATION, ("jfr-gc-pause-events", *_GC, "gc-heap-saturation")), "", shown=False),
)

# Rules in the order they run, what each needs, and its severity.
RULES = (
    Staged("correlation-memory-pressure", (_GC, ("nmt-gc-native-pressure", "nmt-native-allocation-growth", *_PMAP)), "CRITICAL"),
    Staged("correlation-jfr-gc-heap-pressure", (("align:jfr-gc-heap-pressure",), (*_GC, "gc-heap-saturation"), (*_ALLOCATION, *_RETENTION)), "HIGH", (("CRITICAL", ("gc-repeated-full-gcs",)),), ("apart:jfr-gc", "apart:heap")),
    Staged("correlation-jfr-thread-contention", (("align:jfr-thread-dump-contention",), ("jfr-lock-contention-events", "jfr-thread-park-events"), ("thread-dump-java-deadlock", *_STUCK)), "HIGH", (("CRITICAL", ("thread-dump-java-deadlock",)),), _APART_DUMP),
    Staged("correlation-downstream-io-pileup", (("thread-dump-downstream-io-pileup",), ("jfr-io-latency-events",)), "HIGH", (), _APART_DUMP),
    Staged("correlation-forkjoin-starvation", (("thread-dump-forkjoin-starvation",), ("jfr-thread-park-events",)), "HIGH", (), _APART_DUMP),
    Staged("correlation-virtual-thread-pinning", (("thread-dump-virtual-thread-pinning",), ("jfr-virtual-thread-pinning",)), "HIGH", (), _APART_DUMP),
    Staged("correlation-busy-spin-hot-path", (("thread-dump-busy-spin-thread",), ("jfr-execution-hot-path",)), "HIGH", (), _APART_DUMP),
    Staged("correlation-thread-pool-thread-pressure", (("align:thread-dump-nmt-thread-pressure",), _STUCK, ("nmt-thread-stack-pressure",)), "HIGH", (), ("apart:thread-dump-nmt",)),
    Staged("correlation-native-thread-exhaustion-confirmed", (("align:thread-dump-nmt-thread-pressure",), ("hs-err-native-thread-exhaustion",), _STUCK, ("nmt-thread-stack-pressure",)), "CRITICAL", (), ("apart:thread-dump-nmt", "apart:hs-err-native")),
    Staged("correlation-container-memory-pressure", (_CONTAINER, (*_GC, "hs-err-native-allocation-failure", "hs-err-compressed-class-space-oom", *_NMT, "nmt-compressed-class-space-pressure", *_PMAP, *_HISTOGRAM, "correlation-memory-pressure")), "HIGH", (("CRITICAL", ("container-memory-oom-events", "hs-err-native-allocation-failure", "hs-err-compressed-class-space-oom")),)),
    Staged("correlation-container-oom-escalation", (_OOM, (*_CONTAINER, "correlation-container-memory-pressure")), "CRITICAL", (), ("apart:container-oom",)),
    Staged("correlation-jvm-memory-escalated-to-oom", (_OOM, (*_GC, "gc-metaspace-full-gcs", *_NMT, *_PMAP, *_HISTOGRAM, "correlation-memory-pressure")), "CRITICAL"),
    Staged("correlation-jfr-metaspace-class-pressure", (("gc-metaspace-full-gcs",), _META, ("jfr-class-loading-pressure",), ("align:jfr-metaspace-class-pressure",)), "HIGH", (), ("apart:jfr-gc",)),
    Staged("correlation-metaspace-class-pressure", (("gc-metaspace-full-gcs",), _META), "HIGH", (), ("correlation-jfr-metaspace-class-pressure",)),
    Staged("correlation-code-cache-exhaustion-confirmed", (("align:jfr-code-cache-pressure",), ("jfr-code-cache-pressure",), ("hs-err-code-cache-full",)), "HIGH", (("CRITICAL", ("hs-err-fatal-signal",)),)),
    Staged("correlation-code-cache-pressure", (("align:jfr-code-cache-pressure",), ("jfr-code-cache-pressure",), ("nmt-code-cache-pressure",)), "HIGH", (), ("hs-err-code-cache-full",)),
    Staged("correlation-native-reservation-mismatch", (("align:nmt-pmap-reservation-mismatch",), ("nmt-reserved-committed-mismatch",), ("pmap-virtual-resident-mismatch",)), "MEDIUM", (), ("apart:nmt-pmap",)),
    Staged("correlation-native-pressure", (_PMAP, ("nmt-thread-stack-pressure", "nmt-metaspace-pressure", "nmt-native-allocation-growth", "nmt-code-cache-pressure", "nmt-gc-native-pressure"), ("state:native-pressure-open",)), "HIGH"),
    Staged("correlation-mixed-heap-native-pressure", ((*_HISTOGRAM, "compare-heap-retention-pattern", "compare-heap-payload-growth", "compare-heap-growth", "state:jfr-heap-side"), (*_PMAP, "nmt-native-allocation-growth", "nmt-thread-stack-pressure", "nmt-metaspace-pressure", "nmt-gc-native-pressure", "compare-pmap-growth", "compare-pmap-reserved-expansion", "compare-nmt-native-growth")), "HIGH"),
    Staged("correlation-compressed-class-space-exhaustion", (("align:compressed-class-space-pressure",), ("hs-err-compressed-class-space-oom",), ("nmt-compressed-class-space-pressure",)), "CRITICAL", (), ("apart:hs-err-native",)),
    Staged("correlation-native-oom-confirmed", (("hs-err-native-allocation-failure",), (*_PMAP, "nmt-native-allocation-growth", "nmt-thread-stack-pressure", "nmt-metaspace-pressure", "nmt-code-cache-pressure", "correlation-native-pressure")), "CRITICAL", (), ("apart:hs-err-native",)),
    Staged("correlation-crash-under-memory-distress", (("hs-err-fatal-signal", "hs-err-native-allocation-failure", "hs-err-native-thread-exhaustion", "hs-err-compressed-class-space-oom"), (*_GC, "nmt-compressed-class-space-pressure", "correlation-memory-pressure", "correlation-metaspace-class-pressure", "correlation-compressed-class-space-exhaustion", "correlation-mixed-heap-native-pressure", "correlation-native-oom-confirmed", "correlation-thread-pool-thread-pressure", "correlation-native-thread-exhaustion-confirmed")), "CRITICAL"),
)


def aligned(windows: DataFrame, keys: list[str], name: str, first: str, second: str, tolerance_us: int) -> DataFrame:
    """keys, finding_id: ``align:name`` or ``apart:name`` for the first windows (keys, kind, start_us, end_us) of two kinds of artifacts.

    Windows that meet or follow within the tolerance align; without a shared clock nothing is known and there is no row.
    """
    side = lambda kind, p: windows.where(F.col("kind") == kind).groupBy(*keys).agg(F.min(F.struct("start_us", "end_us")).alias("w")).select(*keys, F.col("w.start_us").alias(f"{p}_lo"), F.col("w.end_us").alias(f"{p}_hi"))
    both = side(first, "a").join(side(second, "b"), keys)
    status, _ = compare.alignment(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), tolerance_us)
    meaning = F.when(status == compare.APART[0], F.lit(f"apart:{name}")).when(status != compare.NO_CLOCK[0], F.lit(f"align:{name}"))
    return both.select(*keys, meaning.alias("finding_id")).where("finding_id IS NOT NULL")


def correlate_incident(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, finding_id, severity, position of all rules that fire for each incident."""
    return correlate(findings, keys, (*STATES, *RULES))
