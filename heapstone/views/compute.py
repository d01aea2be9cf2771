"""One door to the views: a kind of artifact and a request give a table. The first trigger that the request holds decides, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.operators.context import Selector
from heapstone.parse import gc, incidents, jfr, memory, threads
from heapstone.views import gc as g
from heapstone.views import jfr as j
from heapstone.views import snapshots as s


@dataclass(frozen=True)
class View:
    """A view's id, the texts or selector keys that ask for it, and how it is computed from (source, selector)."""

    id: str
    triggers: tuple[str, ...]
    keys: tuple[str, ...]
    run: Callable[[Source, Selector], DataFrame]


@dataclass
class Source:
    """What views read: lines of a kind's artifacts, their contents (GC and crash logs), or a recording's events."""

    lines: DataFrame | None = None
    artifacts: DataFrame | None = None
    recording: DataFrame | None = None
    year: int = 1970
    _events: DataFrame | None = field(default=None, repr=False, compare=False)

    def events(self) -> DataFrame:
        """Parsed and stored once for all views of this source."""
        if self._events is None:
            self._events = gc.stored_events(self.lines)
        return self._events

    def timeline(self) -> DataFrame:
        return jfr.timeline(self.recording)


def _summary(columns: tuple[str, ...]) -> Callable[[Source, Selector], DataFrame]:
    return lambda source, _: gc.summary_of(gc.collectors(source.artifacts), source.events()).select("artifact_id", *columns)


PRESSURE = ("collector", "full_gc_count", "p95_pause_ms", "max_pause_ms", "peak_post_gc_occupancy_ratio", "near_capacity_count", "near_capacity_streak", "metaspace_full_gc_count", "dominant_cause_by_total_ms", "evacuation_failure_pause_count", "to_space_exhausted_count", "full_gc_streak", "low_reclaim_full_count", "concurrent_mode_failure_count", "allocation_stall_count", "stop_the_world_pct")
RECOVERY = ("young_count", "mixed_count", "full_gc_count", "average_reclaimed_mb", "average_post_gc_occupancy_ratio", "high_retained_count", "near_capacity_count", "near_capacity_streak", "peak_post_gc_occupancy_ratio")
PROGRESSION = ("young_before_first_mixed_count", "mixed_before_first_full_count", "full_after_mixed_count", "high_retained_mixed_count", "low_reclaim_full_count", "low_reclaim_full_streak", "average_full_gc_reclaimed_mb", "average_full_gc_reclaimed_share")

GC = (
    View("gc-incident", ("incident=", "dominant-window"), ("incident",), lambda d, q: g.incident(d.events(), gc.collectors(d.artifacts), q.get("incident"))),
    View("gc-streak", ("streak=", "streak"), ("streak",), lambda d, q: g.streaks(d.events()) if not q.get("streak") else g.streaks(d.events()).where(F.col("streak").startswith(q.get("streak").lower()))),
    View("gc-time-window-summary", (), ("start", "end", "windowseconds", "timestampstart", "timestampend"), lambda d, q: g.window_summary(e := d.events(), g.resolve(e, q))),
    View("gc-pause-focus", (), ("cause", "pausetype"), lambda d, q: g.pause_focus(d.events(), q)),
    View("gc-phase-focus", (), ("phase", "phasekind"), lambda d, q: g.phase_focus(d.events(), q)),
    View("gc-signal-focus", (), ("signaltype",), lambda d, q: g.signal_focus(d.events(), q)),
    View("gc-id-focus", (), ("gcid",), lambda d, q: g.gc_id_focus(d.events(), int(q.number("gcId") or -1))),
    View("gc-collector-pressure-summary", ("collector-pressure", "g1-pressure", "cms-pressure", "zgc-pressure"), (), _summary(PRESSURE)),
    View("gc-cause-distribution", ("cause",), (), lambda d, q: g.cause_distribution(d.events())),
    View("gc-recovery-summary", ("recovery", "headroom"), (), _summary(RECOVERY)),
    View("g1-cycle-progression-summary", ("g1-cycle", "mixed-phase", "full-recovery"), (), _summary(PROGRESSION)),
    View("gc-metaspace-summary", ("metaspace",), (), lambda d, q: g.metaspace_summary(d.events())),
    View("gc-failure-summary", ("failure", "evacuation", "metadata"), (), lambda d, q: g.failure_summary(d.events())),
    View("gc-phase-summary", ("phase", "concurrent"), (), lambda d, q: g.phase_summary(d.events())),
    View("gc-worker-summary", ("worker",), (), lambda d, q: g.worker_summary(d.events())),
    View("gc-cpu-summary", ("cpu",), (), lambda d, q: g.cpu_summary(d.events())),
    View("gc-humongous-summary", ("humongous",), (), lambda d, q: g.humongous_summary(d.events())),
    View("gc-pause-breakdown", ("breakdown",), (), lambda d, q: gc.breakdown(gc.pauses_of(d.events()), "pause_type")),
    View("gc-occupancy-progression", ("occupancy",), (), lambda d, q: g.occupancy_progression(d.events())),
    View("gc-allocation-stalls", ("stall",), (), lambda d, q: g.stall_summary(d.events())),
    View("gc-cycle-summary", ("cycle",), (), lambda d, q: g.cycle_summary(d.events())),
    View("gc-pause-percentiles", ("",), (), lambda d, q: g.pause_percentiles(d.events())),
)

JFR = (
    View("jfr-chronology-highlights", ("chronology",), (), lambda d, q: jfr.chronology_highlights(t := d.timeline(), jfr.incident_windows(t))),
    View("jfr-event-family", (), ("eventtype",), lambda d, q: j.slice_view(j.by_family(d.timeline(), q.get("eventType")))),
    View("jfr-thread", (), ("thread",), lambda d, q: j.slice_view(j.by_thread(d.timeline(), q.get("thread")))),
    View("jfr-hotspot", (), ("hotspot",), lambda d, q: j.slice_view(j.by_hotspot(d.timeline(), q.get("hotspot")))),
    View("jfr-allocation-class", (), ("class", "allocationclass"), lambda d, q: j.slice_view(j.by_class(d.timeline(), q.get("class", "allocationClass")))),
    View("jfr-old-object", (), ("oldobject",), lambda d, q: j.slice_view(j.by_old_object(d.timeline(), q.get("oldObject")))),
    View("jfr-incident", ("incident",), ("incident",), lambda d, q: j.incident(d.timeline(), q.get("incident") or "")),
    View("jfr-time-window", (), ("start", "end"), lambda d, q: j.slice_view(j.time_window(d.timeline(), q))),
    *(View(f"jfr-{name}", texts, (), lambda d, q, f=families: j.slice_view(d.timeline().where(F.col("signal_family").isin(*f)))) for name, texts, families in (("class-loading", ("class-load",), ("classLoading",)), ("allocation", ("allocation",), ("allocation",)), ("old-objects", ("old",), ("oldObject",)), ("monitor-wait", ("monitor-wait",), ("monitorWait",)), ("cpu-load", ("cpu-load", "cpu"), ("cpuLoad",)), ("runtime", ("runtime",), jfr.RUNTIME), ("execution", ("execution",), ("executionSample",)))),
    View("jfr-families", ("",), (), lambda d, q: jfr.by_family(d.timeline())),
)

OTHERS = {
    "THREAD_DUMP": (
        View("thread-pools", ("pool",), (), lambda d, q: threads.pools(threads.threads(d.lines))), View("thread-deadlocks", ("deadlock",), (), lambda d, q: threads.deadlocks(d.lines)), View("thread-blocked-clusters", ("block", "lock", "contention"), (), lambda d, q: s.blocked_clusters(d.lines)), View("thread-states", ("",), (), lambda d, q: s.thread_states(d.lines)),
    ),
    "HS_ERR_LOG": tuple(View(f"crash-{name}", texts, (), lambda d, q, c=columns: incidents.crash_summary(d.artifacts).select("artifact_id", *c)) for name, texts, columns in (("vm", ("vm", "version"), ("jre_version", "vm", "command_line")), ("code-cache", ("code",), ("code_cache_full", "code_cache_size_kb", "code_cache_used_kb", "code_cache_free_kb")), ("thread", ("thread",), ("current_thread_name", "crash_type")), ("summary", ("",), ("signal", "crash_type", "problem_frame", "problem_symbol", "requested_bytes", "elapsed_s")))),
    "NMT": (
        *(View(f"nmt-{name}", texts, (), lambda d, q, c=columns: memory.nmt_summary(d.lines).select("artifact_id", *c)) for name, texts, columns in (("class-space", ("class-space", "class space"), ("class_space_reserved_kb", "class_space_committed_kb", "class_space_used_kb", "class_space_used_delta_kb")), ("internal", ("internal", "arena"), ("internal_committed_kb", "internal_committed_delta_kb")), ("metaspace", ("metaspace", "class"), ("metaspace_committed_kb", "metaspace_used_kb", "metaspace_used_delta_kb", "class_count")))),
        View("nmt-reservation-gap", ("reserv", "gap"), (), lambda d, q: s.reservation_gaps(d.lines)), View("nmt-threads", ("thread", "stack"), (), lambda d, q: memory.nmt_summary(d.lines).select("artifact_id", "thread_count", "stack_reserved_kb", "stack_committed_kb")), View("nmt-deltas", ("delta", "growth"), (), lambda d, q: s.category_deltas(d.lines)), View("nmt-categories", ("",), (), lambda d, q: memory.nmt_categories(d.lines)),
    ),
    "HEAP_HISTOGRAM": (View("histogram-families", ("famil", "cache", "collection", "payload"), (), lambda d, q: memory.histogram_summary(d.lines).select("artifact_id", *(f"{f}_{m}" for f in memory.FAMILIES for m in ("bytes", "instances")))), View("histogram-top-consumers", ("",), (), lambda d, q: s.top_consumers(d.lines))),
    "PMAP": (View("pmap-categories", ("categor",), (), lambda d, q: memory.pmap_categories(d.lines)), View("pmap-resident", ("resident", "rss"), (), lambda d, q: s.top_mappings(d.lines, "rss_kb")), View("pmap-reservation", ("reserv", "gap"), (), lambda d, q: s.top_mappings(d.lines, "reserved_gap_kb")), View("pmap-summary", ("",), (), lambda d, q: memory.pmap_summary(d.lines))),
    "CONTAINER_MEMORY": (View("container-pressure", ("pressure", "psi"), (), lambda d, q: memory.cgroup_pressure(d.lines)), View("container-events", ("event", "throttl"), (), lambda d, q: s.container_events(d.lines)), View("container-budget", ("",), (), lambda d, q: s.memory_budget(d.lines))),
    "OOM_SIGNAL": (View("oom-kernel", ("kernel", "kill"), (), lambda d, q: s.kernel_kills(d.lines, d.year)), View("oom-pods", ("pod", "container", "restart"), (), lambda d, q: incidents.pods(d.lines)), View("oom-summary", ("",), (), lambda d, q: incidents.oom_summary(d.lines, d.year))),
}
VIEWS = {"GC_LOG": GC, "JFR": JFR, **OTHERS}


def choose(kind: str, request: str | None) -> tuple[View, Selector]:
    """The view that a request asks for: the first whose selector key is set or whose text the request holds; the last one of a kind is its default."""
    selector, text = j.parse(request) if kind == "JFR" and "=" in (request or "") else Selector.parse(request), (request or "").lower()
    for view in VIEWS[kind]:
        if any(k in selector.values for k in view.keys) or any(t and t in text for t in view.triggers):
            return view, selector
    return VIEWS[kind][-1], selector


def compute(kind: str, source: Source, request: str | None = None) -> tuple[str, DataFrame]:
    """The view's id and its table."""
    view, selector = choose(kind, request)
    return view.id, view.run(source, selector)
