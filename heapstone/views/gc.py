"""Focused views of GC events: what a request asks of one or many logs, computed over the typed events of ``heapstone.parse.gc.events``.

Each view has one row an artifact, or ranked rows with ``position`` from 1. Events without an elapsed time are in no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.context import Selector
from heapstone.operators.ordered import nearest_rank
from heapstone.operators.ranking import dominant, ratio, top_per_group
from heapstone.operators.timeline import best_gap_cluster, gap_clusters
from heapstone.parse import gc

KEY = ["artifact_id"]
#: What keeps two events of a streak together, the width of a window whose ends are unknown, rows of ranked lists, padding of an incident.
GAP_S, GAP_LINES, WIDTH_S, TOP, PAD_S = 2.0, 160, 15.0, 6, 0.5
TIMELINE = ("pause", "cycle", "stall", "phase", "signal")


def full_gc() -> Column:
    return (F.col("kind") == "pause") & F.lower(F.coalesce("event", F.lit(""))).contains("full")


def evacuation_failure() -> Column:
    return (F.col("kind") == "pause") & (F.lower(F.coalesce("event", F.lit(""))).contains("evacuation failure") | F.lower("raw_line").contains("to-space exhausted"))


def signal(*types: str) -> Column:
    return (F.col("kind") == "signal") & (F.col("signal_type").isin(*types) if types else F.lit(True))


def distress() -> Column:
    """Full collections, failed evacuations and every failure signal."""
    return full_gc() | evacuation_failure() | signal()


def concurrent_phase() -> Column:
    return (F.col("kind") == "phase") & (F.col("phase_kind") == "CONCURRENT")


def weight() -> Column:
    """An event's weight in a cluster: 1 at least, else its milliseconds."""
    return F.greatest(F.lit(1.0), F.coalesce("amount_ms", F.lit(0.0)))


def chronology() -> list[Column]:
    return [F.when(F.col("line_no") > 0, 0).otherwise(1), F.coalesce("line_no", F.lit(0)), F.col("elapsed_s")]


# --- windows ---


def seconds_literal(token: str | None) -> float | None:
    """``12``, ``12.5`` or ``12.5s``; None for anything else."""
    text = (token or "").strip().lower().removesuffix("s")
    return float(text) if text and text.replace(".", "", 1).isdigit() and not text.startswith(".") else None


def time_token(events: DataFrame, token: str | None, first: bool) -> DataFrame | None:
    """artifact_id, s: the seconds that a token stands for in each log: a literal, else the first (last) event whose clock or line holds it."""
    if not (token or "").strip():
        return None
    literal = seconds_literal(token)
    if literal is not None:
        return events.select(*KEY).distinct().withColumn("s", F.lit(literal))
    text = token.strip().lower()
    holds = F.lower(F.coalesce("abs_ts", F.lit(""))).contains(text) | F.lower("raw_line").contains(text)
    pick_one = F.min_by if first else F.max_by
    return events.where(holds & F.col("elapsed_s").isNotNull()).groupBy(*KEY).agg(pick_one("elapsed_s", F.struct(*chronology())).alias("s"))


def resolve(events: DataFrame, selector: Selector) -> DataFrame:
    """artifact_id, lo, hi: the window that start, end, windowSeconds and gcId (as an anchor) ask for; logs where none can be found are left out."""
    timeline = events.where(F.col("kind").isin(*TIMELINE))
    width, gc_id = selector.number("windowSeconds"), selector.number("gcId")
    width = width if width and width > 0 else None
    out = timeline.select(*KEY).distinct()
    anchor = timeline.where(F.col("gc_id") == int(gc_id)).groupBy(*KEY).agg(F.min_by("elapsed_s", F.struct(*chronology())).alias("s")) if gc_id is not None else None
    for name, found in (("start", time_token(timeline, selector.get("start", "timestampStart"), True)), ("end", time_token(timeline, selector.get("end", "timestampEnd"), False)), ("anchor", anchor)):
        out = out.withColumn(name, F.lit(None).cast("double")) if found is None else out.join(found.withColumnRenamed("s", name), KEY, "left")
    span, given = F.lit(width or WIDTH_S), F.lit(width is not None)
    anchored = F.col("start").isNull() & F.col("end").isNull() & given & F.col("anchor").isNotNull()
    low = F.when(anchored, F.greatest(F.lit(0.0), F.col("anchor") - span / 2)).otherwise(F.coalesce("start", F.greatest(F.lit(0.0), F.col("end") - span)))
    high = F.when(anchored, F.col("anchor") + span / 2).otherwise(F.coalesce("end", F.col("start") + span))
    return out.select(*KEY, F.least(low, high).alias("lo"), F.greatest(low, high).alias("hi")).where("lo IS NOT NULL AND hi IS NOT NULL")


def inside(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The timeline's events within each log's window, ends included."""
    return events.where(F.col("kind").isin(*TIMELINE)).join(windows, KEY).where(F.col("elapsed_s").between(F.col("lo"), F.col("hi")))


def window_summary(events: DataFrame, windows: DataFrame) -> DataFrame:
    """One row a log: the window, counts by kind, pause totals and percentiles, the share of stopped time (stalls included, 100 at most)."""
    rows = inside(events, windows)
    paused = (F.col("kind") == "pause") & (F.col("amount_ms") > 0)
    sums = rows.groupBy(*KEY).agg(
        F.min("lo").alias("start_s"), F.min("hi").alias("end_s"), F.count_if(F.col("kind") == "pause").alias("pause_count"), F.count_if(full_gc()).alias("full_gc_count"), F.count_if(evacuation_failure()).alias("evacuation_failure_count"), F.count_if(F.col("kind") == "stall").alias("stall_count"), F.count_if(F.col("kind") == "cycle").alias("cycle_count"),
        F.count_if(F.col("kind") == "phase").alias("phase_count"), F.count_if(signal()).alias("signal_count"), F.count_if(signal("CONCURRENT_ABORT")).alias("concurrent_abort_count"), F.count_if(signal("FULL_COMPACTION_ATTEMPT")).alias("compaction_attempt_count"), F.coalesce(F.sum(F.when(paused, F.col("amount_ms"))), F.lit(0.0)).alias("total_pause_ms"),
        F.coalesce(F.max(F.when(paused, F.col("amount_ms"))), F.lit(0.0)).alias("max_pause_ms"), F.coalesce(F.sum(F.when(F.col("kind") == "stall", F.col("amount_ms"))), F.lit(0.0)).alias("_stalled"),
    )
    ranks = nearest_rank(rows.where(paused), KEY, "amount_ms", {"p95_pause_ms": 0.95})
    span = (F.col("end_s") - F.col("start_s")) * 1000
    out = windows.select(*KEY, F.col("lo").alias("start_s"), F.col("hi").alias("end_s")).join(sums.drop("start_s", "end_s"), KEY, "left").join(ranks, KEY, "left").fillna(0)
    return out.withColumn("overhead_pct", F.when(span > 0, F.least(F.lit(100.0), 100 * (F.col("total_pause_ms") + F.col("_stalled")) / span)).otherwise(F.lit(0.0))).drop("_stalled")


def window_tops(events: DataFrame, windows: DataFrame, limit: int = TOP) -> DataFrame:
    """Each window's longest pauses and phases and its first failure signals: artifact_id, kind, position, line_no, gc_id, name, amount_ms."""
    rows = inside(events, windows).where(F.col("kind").isin("pause", "phase", "signal", "stall"))
    by = F.when(F.col("kind") == "signal", F.lit(0.0)).otherwise(-F.coalesce("amount_ms", F.lit(0.0)))
    return top_per_group(rows, [*KEY, "kind"], [by, *chronology()], limit).select(*KEY, "kind", "position", "line_no", "gc_id", named().alias("name"), "amount_ms")


def named() -> Column:
    return F.coalesce("event", "phase", "signal_type", "thread")


# --- streaks and incidents ---


def first_wins(events: DataFrame) -> DataFrame:
    """Each event once: events of one line, GC number, name, signal and phase are the same; the first kind on the timeline stays."""
    place = F.array_position(F.array(*map(F.lit, TIMELINE)), F.col("kind"))
    key = [*KEY, "line_no", "gc_id", "event", "signal_type", "phase"]
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(place, *chronology()))).where("_r = 1").drop("_r")


def streaks(events: DataFrame) -> DataFrame:
    """artifact_id, streak, n, weight, first_line, last_line, start_s, end_s: the best cluster of full collections, failed evacuations, failure signals and all distress."""
    kinds = F.array(*(F.when(test, F.lit(name)) for name, test in (("full-gc", full_gc()), ("evacuation-failure", evacuation_failure()), ("failure-signal", signal()), ("distress", distress()))))
    marked = events.where(distress()).select("*", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("streak"))
    return cluster_of(marked, [*KEY, "streak"])


def cluster_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, weight, first_line, last_line, start_s, end_s of the best cluster of each group."""
    rows = events.withColumn("_w", F.round(weight() * 1000).cast("long"))
    best = best_gap_cluster(rows, keys, "elapsed_s", "line_no", F.col("_w"), GAP_S, GAP_LINES)
    members = gap_clusters(rows, keys, "elapsed_s", "line_no", GAP_S, GAP_LINES).join(best.select(*keys, "cluster"), [*keys, "cluster"])
    spans = members.groupBy(*keys).agg(F.min("elapsed_s").alias("start_s"), F.max("elapsed_s").alias("end_s"), F.max("amount_ms").alias("max_ms"), F.count("elapsed_s").alias("timed"))
    return best.join(spans, keys).select(*keys, "n", (F.col("weight") / 1000).alias("weight"), "first_line", "last_line", "start_s", "end_s", "max_ms", "timed")


def _single(events: DataFrame, test: Column, by: Column, largest: bool) -> DataFrame:
    """One event a log: the largest (first) by ``by``, ties to the earlier; as a cluster of one."""
    order = F.struct((-by if largest else F.lit(0.0)).alias("a"), *(c.alias(f"o{k}") for k, c in enumerate(chronology())))
    chosen = events.where(test & F.col("elapsed_s").isNotNull()).groupBy(*KEY).agg(F.min_by(F.struct("elapsed_s", F.coalesce("amount_ms", F.lit(0.0)).alias("ms"), "line_no"), order).alias("e"))
    return chosen.select(*KEY, F.lit(1).cast("long").alias("n"), F.col("e.line_no").alias("first_line"), F.col("e.line_no").alias("last_line"), F.col("e.elapsed_s").alias("start_s"), F.col("e.elapsed_s").alias("end_s"), F.col("e.ms").alias("max_ms"))


def _clustered(events: DataFrame, test: Column) -> DataFrame:
    found = cluster_of(first_wins(events.where(test)), KEY).where("timed > 0")
    return found.select(*KEY, "n", "first_line", "last_line", "start_s", "end_s", "max_ms")


def _occupancy() -> Column:
    return F.coalesce("after_ratio", F.when(F.col("capacity_bytes") > 0, F.col("after_bytes") / F.col("capacity_bytes")))


#: Names that incidents go by.
ALIASES = {
    "failure": "failure-cluster", "distress": "failure-cluster", "distress-cluster": "failure-cluster", "peak": "peak-occupancy", "occupancy": "peak-occupancy", "peak-retention": "peak-occupancy", "latest": "tail", "latest-tail": "tail", "recent": "tail", "full-gc": "longest-full-gc", "full-gc-window": "longest-full-gc",
    "stall": "allocation-stall", "zgc-stall": "allocation-stall", "compaction-attempt": "full-compaction-attempt", "to-space-exhausted": "to-space-distress", "concurrent-mode-failure": "cms-fallback", "": "dominant-pressure", "dominant": "dominant-pressure", "dominant-window": "dominant-pressure", "pressure": "dominant-pressure", "pressure-window": "dominant-pressure",
}


def _fallback() -> Column:
    return full_gc() | signal("CONCURRENT_MODE_FAILURE") | concurrent_phase()


def incident(events: DataFrame, collectors: DataFrame, name: str | None = None) -> DataFrame:
    """artifact_id, incident, n, first_line, last_line, lo, hi: the window of an incident by its name or alias; unknown names are the dominant one.

    One event is padded by half a second or its own length, whichever is more, a cluster by half a second; no window begins below 0.
    The dominant incident depends on the collector: what failed first of all, else what the collector did most.
    """
    wanted = (name or "").strip().lower().replace("_", "-").replace(" ", "-")
    wanted = ALIASES.get(wanted, wanted)
    amount = F.coalesce("amount_ms", F.lit(0.0))
    single = {
        "longest-full-gc": (full_gc(), amount, True), "allocation-stall": (F.col("kind") == "stall", amount, True), "evacuation-failure": (evacuation_failure(), amount, False), "concurrent-abort": (signal("CONCURRENT_ABORT"), amount, False), "full-compaction-attempt": (signal("FULL_COMPACTION_ATTEMPT"), amount, False),
        "to-space-distress": (signal("TO_SPACE_EXHAUSTED"), amount, False), "longest-concurrent-phase": (concurrent_phase(), amount, True), "peak-occupancy": (F.col("kind").isin("pause", "cycle") & (_occupancy() > 0), F.coalesce(_occupancy(), F.lit(0.0)), True),
    }
    if wanted in single:
        found = _single(events, *single[wanted])
    elif wanted == "failure-cluster":
        found = _clustered(events, distress())
    elif wanted == "cms-fallback":
        found = _clustered(events, _fallback())
    elif wanted == "tail":
        last = events.where(F.col("kind").isin(*TIMELINE)).withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*(c.desc() for c in chronology())))).where("_r <= 6 AND elapsed_s IS NOT NULL")
        found = last.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("elapsed_s").alias("start_s"), F.max("elapsed_s").alias("end_s"), F.max(amount).alias("max_ms"))
    else:
        wanted, found = "dominant-pressure", _dominant_incident(events, collectors)
    pad = F.when(F.col("n") == 1, F.greatest(F.lit(PAD_S), F.coalesce("max_ms", F.lit(0.0)) / 1000)).otherwise(F.lit(PAD_S))
    return found.select(*KEY, F.lit(wanted).alias("incident"), "n", "first_line", "last_line", F.greatest(F.lit(0.0), F.col("start_s") - pad).alias("lo"), (F.col("end_s") + pad).alias("hi"))


def _dominant_incident(events: DataFrame, collectors: DataFrame) -> DataFrame:
    """By collector, the best cluster of its first choice of events, else of its second."""
    kind = F.col("kind")
    choices = {
        "G1": (distress(), kind == "pause"), "CMS": (_fallback(), (kind == "pause") | concurrent_phase()), "Serial": (full_gc(), kind == "pause"), "Parallel": (full_gc(), kind == "pause"), "ZGC": (kind == "stall", kind.isin("stall", "cycle", "pause")),
    }
    rows = events.join(collectors, KEY)
    name = F.col("collector")
    known = name.isin(*choices)
    tests = []
    for k in (0, 1):
        other = distress() if k == 0 else kind.isin("pause", "signal", "stall", "phase")
        test = ~known & other
        for collector, chosen in choices.items():
            test = test | ((name == collector) & chosen[k])
        tests.append(test)
    order = F.array(F.when(tests[0], F.lit(0)), F.when(tests[1], F.lit(1)))
    marked = rows.select("*", F.explode(F.filter(order, lambda x: x.isNotNull())).alias("choice"))
    place = F.array_position(F.array(*map(F.lit, TIMELINE)), kind)
    once = marked.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "choice", "line_no", "gc_id", "event", "signal_type", "phase").orderBy(place, *chronology()))).where("_r = 1").drop("_r")
    found = cluster_of(once, [*KEY, "choice"]).where("timed > 0")
    best = found.groupBy(*KEY).agg(F.min_by(F.struct("n", "first_line", "last_line", "start_s", "end_s", "max_ms"), "choice").alias("b"))
    return best.select(*KEY, "b.*")


# --- focuses ---


def pause_focus(events: DataFrame, selector: Selector) -> DataFrame:
    """Pauses by cause and type (contained text, any case): count, total, percentiles, maximum, their share of all pause time.

    Times are summed in whole nanoseconds, so that the order of the rows doesn't show in the last digits of total and share.
    Percentiles are those of all ``n`` pauses, also of such that took 0 ms. ``all_ms`` is what the share is of.
    """
    paused = events.where(F.col("kind") == "pause").withColumn("_ns", F.col("amount_ms").cast("decimal(18,6)") * 1_000_000)
    rows = paused.where(selector.matching({"cause": "cause", "pausetype": "pause_type"}))
    sums = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("_ns").cast("double").alias("_sum"), F.max("amount_ms").alias("max_ms"))
    ranks = nearest_rank(rows, KEY, "amount_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    overall = paused.groupBy(*KEY).agg(F.sum("_ns").cast("double").alias("_all"))
    shown = [F.col(c) for c in (*KEY, "n")], [F.col(c) for c in ("max_ms", *(c for c in ranks.columns if c not in KEY))]
    joined = sums.join(ranks, KEY, "left").join(overall, KEY)
    return joined.select(*shown[0], (F.col("_sum") / 1_000_000).alias("total_ms"), *shown[1], (F.col("_all") / 1_000_000).alias("all_ms"), ratio(F.col("_sum"), F.col("_all")).alias("share"))


def phase_focus(events: DataFrame, selector: Selector) -> DataFrame:
    """Phases by name and kind: count, total, maximum."""
    rows = events.where(F.col("kind") == "phase").where(selector.matching({"phase": "phase", "phasekind": "phase_kind"}))
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("amount_ms").alias("total_ms"), F.max("amount_ms").alias("max_ms"), F.max_by("phase", "amount_ms").alias("longest"))


def signal_focus(events: DataFrame, selector: Selector) -> DataFrame:
    """Failure signals by type: count, first and last line."""
    rows = events.where(signal()).where(selector.matching({"signaltype": "signal_type", "signal": "signal_type"}))
    return rows.groupBy(*KEY, "signal_type").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def gc_id_focus(events: DataFrame, gc_id: int) -> DataFrame:
    """All events of one GC number by kind: count, total and maximum, first and last line."""
    rows = events.where(F.col("gc_id") == gc_id)
    return rows.groupBy(*KEY, "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount_ms"), F.lit(0.0)).alias("total_ms"), F.max("amount_ms").alias("max_ms"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def longest(events: DataFrame, kind: str, limit: int) -> DataFrame:
    """The longest events of a kind: artifact_id, position, line_no, gc_id, name, amount_ms."""
    rows = events.where(F.col("kind") == kind)
    return top_per_group(rows, KEY, [F.desc_nulls_last("amount_ms"), *chronology()], limit).select(*KEY, "position", "line_no", "gc_id", named().alias("name"), "amount_ms")


def occupancy_progression(events: DataFrame, limit: int = 10) -> DataFrame:
    """The first pauses whose occupancy is known: artifact_id, position, line_no, gc_id, before and after as ratios."""
    rows = gc.pauses_of(events).where("after_ratio IS NOT NULL")
    return top_per_group(rows, KEY, chronology(), limit).select(*KEY, "position", "line_no", "gc_id", "before_ratio", "after_ratio")


def pause_percentiles(events: DataFrame) -> DataFrame:
    """p50, p95, p99 and maximum of pauses above 0, and their number."""
    rows = events.where((F.col("kind") == "pause") & (F.col("amount_ms") > 0))
    ranks = nearest_rank(rows, KEY, "amount_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return ranks.join(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("amount_ms").alias("max_ms")), KEY)


def cause_distribution(events: DataFrame) -> DataFrame:
    """artifact_id, cause, n, total_ms, max_ms, and whether the cause is the dominant one by count and by time (ties: seen first)."""
    rows = gc.pauses_of(events)
    sums = gc.breakdown(rows, "cause")
    by = lambda amount, name: dominant(rows, KEY, "cause", amount, "line_no").select(*KEY, F.col("cause").alias(name))
    tops = by(F.lit(1).cast("long"), "_c").join(by(F.round(F.col("pause_ms") * 1000).cast("long"), "_t"), KEY)
    return sums.join(tops, KEY).select(*KEY, "cause", "n", "total_ms", "max_ms", (F.col("cause") == F.col("_c")).alias("dominant_by_count"), (F.col("cause") == F.col("_t")).alias("dominant_by_time"))


def worker_summary(events: DataFrame) -> DataFrame:
    rows = gc.workers_of(events)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("active").alias("max_active"), F.min("active").alias("min_active"), F.max("available").alias("max_available"), F.max("utilization").alias("peak_utilization"))


def cpu_summary(events: DataFrame) -> DataFrame:
    rows = gc.cpu_of(events)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("user_s").alias("total_user_s"), F.sum("sys_s").alias("total_sys_s"), F.sum("real_s").alias("total_real_s"), F.max("real_s").alias("max_real_s"), F.max("cpu_s").alias("max_cpu_s"), F.max_by("gc_id", "real_s").alias("max_real_gc_id"), F.max("cpu_to_wall").alias("peak_cpu_to_wall"))


def humongous_summary(events: DataFrame) -> DataFrame:
    rows = gc.humongous_of(events)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("before").alias("peak_before"), F.max("after").alias("peak_after"), F.max_by("gc_id", "after").alias("peak_after_gc_id"), F.count_if(F.col("delta") > 0).alias("growth_count"), F.max("delta").alias("max_growth"))


def metaspace_summary(events: DataFrame) -> DataFrame:
    rows, at = gc.metaspace_of(events), F.col("line_no")
    growth = lambda c: (F.max_by(c, at) - F.min_by(c, at)).alias(f"{c.removesuffix('_kb')}_growth_kb")
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.max_by(c, at).alias(f"latest_{c}") for c in ("used_kb", "committed_kb", "reserved_kb")), *(F.max(c).alias(f"peak_{c}") for c in ("used_kb", "committed_kb", "reserved_kb")), F.max("usage_ratio").alias("peak_usage_ratio"), growth("used_kb"), growth("committed_kb"))


def failure_summary(events: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("cause", F.lit("")))
    paused = F.col("kind") == "pause"
    return events.groupBy(*KEY).agg(
        F.count_if(evacuation_failure()).alias("evacuation_failure_count"), F.count_if(paused & low.contains("metadata")).alias("metadata_pause_count"), F.count_if(full_gc() & low.contains("metadata gc clear soft references")).alias("metadata_clear_full_count"),
        *(F.count_if(signal(k)).alias(f"{k.lower()}_count") for k in dict.fromkeys(k for k, _ in gc.SIGNALS)), F.count_if(signal()).alias("signal_count"),
    )


def phase_summary(events: DataFrame) -> DataFrame:
    """artifact_id, phase_kind, n, total and maximum, the longest phase and its GC number."""
    rows = gc.phases_of(events)
    return rows.groupBy(*KEY, "phase_kind").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.max_by("phase", "duration_ms").alias("longest"), F.max_by("gc_id", "duration_ms").alias("longest_gc_id"))


def stall_summary(events: DataFrame) -> DataFrame:
    rows = gc.stalls_of(events)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("stall_ms").alias("total_ms"), F.max("stall_ms").alias("max_ms"), F.count_distinct("thread").alias("threads"))


def cycle_summary(events: DataFrame) -> DataFrame:
    rows = gc.cycles_of(events)
    return rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("duration_ms").alias("longest_ms"), F.max("before_ratio").alias("peak_before_ratio"), F.max("after_ratio").alias("peak_after_ratio"))
