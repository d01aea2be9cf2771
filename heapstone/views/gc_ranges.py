"""Incidents, streaks and time windows of GC logs as ranges of raw lines, with the events each range came from.

Events are those of ``heapstone.parse.gc``, lines (artifact_id, line_no, line). An event's range is widened to the lines nearby that bear its GC number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators import ranges
from heapstone.operators.context import Selector
from heapstone.operators.retrieval import ends
from heapstone.operators.timeline import gap_clusters
from heapstone.views import gc

KEY = ["artifact_id"]


@dataclass(frozen=True)
class Around:
    """Lines before and after an event, how far lines of its number are looked for, and lines around these."""

    before: int
    after: int
    radius: int
    pad: int


#: Ranges of events that were asked for, and of those that make an incident; lines of a dense region, of the tail; windows shown at most.
ASKED, INCIDENT = Around(2, 17, 18, 2), Around(5, 5, 24, 3)
DENSE_LINES, TAIL_LINES, SHOWN = 48, 24, 3
#: Weights that a failure signal and a concurrent phase add in a window.
SIGNAL_WEIGHT, CONCURRENT_WEIGHT = 25.0, 10.0
#: Incidents by collector, and the names incidents go by with the slices tried for each, where COLLECTOR stands for the collector's own.
COLLECTOR = "collector"
BY_COLLECTOR = {"G1": "gc-incident-dominant-g1-distress-window", "CMS": "gc-incident-dominant-cms-fallback-window", "Serial": "gc-incident-dominant-full-gc-window", "Parallel": "gc-incident-dominant-full-gc-window", "ZGC": "gc-incident-dominant-zgc-stall-window"}
TRIED = (
    (("dominant", "dominant-pressure", "dominant-window", "pressure", "pressure-window"), (COLLECTOR, "gc-incident-densest-failure-region", "gc-incident-longest-full-gc", "gc-incident-peak-occupancy", "gc-incident-longest-allocation-stall", "gc-incident-tail")),
    (("failure", "failure-cluster", "distress", "distress-cluster"), ("gc-incident-densest-failure-region", COLLECTOR, "gc-incident-longest-full-gc", "gc-incident-first-evacuation-failure")),
    (("peak", "peak-occupancy", "occupancy", "peak-retention"), ("gc-incident-peak-occupancy",)),
    (("tail", "latest", "latest-tail", "recent"), ("gc-incident-tail",)),
    (("longest-full-gc", "full-gc", "full-gc-window"), ("gc-incident-longest-full-gc",)),
    (("allocation-stall", "stall", "zgc-stall"), ("gc-incident-longest-allocation-stall", COLLECTOR)),
    (("humongous", "humongous-growth"), ("gc-incident-peak-humongous-growth",)),
    (("evacuation-failure",), ("gc-incident-first-evacuation-failure",)),
    (("concurrent-abort",), ("gc-incident-first-concurrent-abort",)),
    (("full-compaction-attempt", "compaction-attempt"), ("gc-incident-first-full-compaction-attempt",)),
    (("to-space-distress", "to-space-exhausted"), ("gc-incident-first-to-space-distress",)),
    (("concurrent-mode-failure", "cms-fallback"), ("gc-incident-dominant-cms-fallback-window", "gc-incident-first-concurrent-mode-failure")),
    (("longest-concurrent-phase",), ("gc-incident-longest-concurrent-phase",)),
)


def tried(name: str) -> tuple[str, ...]:
    """The slices that an incident's name or alias may mean, best first; none for an unknown name."""
    plain = name.strip().lower().replace("_", "-").replace(" ", "-")
    for names, slices in TRIED:
        if plain in names:
            return slices
    return (plain,) if plain.startswith("gc-incident-") else ()


def event_ranges(events: DataFrame, lines: DataFrame, around: Around = ASKED) -> DataFrame:
    """``events`` with first_line and last_line of the raw lines around each, within its log. Events without a line are left out."""
    marks = lines.select(*KEY, F.explode(F.regexp_extract_all("line", F.lit(r"GC\((\d+)\)"), F.lit(1))).alias("gc_id"), "line_no").withColumn("gc_id", F.col("gc_id").try_cast("long"))
    found = ranges.nearby(events.where("line_no > 0").withColumn("gc_id", F.when(F.col("gc_id") > 0, F.col("gc_id"))), marks, "gc_id", around.radius)
    numbered = F.col("gc_id").isNotNull()
    low = F.least(F.col("line_no") - around.before, F.when(numbered, F.col("_first") - around.pad).otherwise(F.col("line_no")))
    high = F.greatest(F.col("line_no") + around.after, F.when(numbered, F.col("_last") + around.pad).otherwise(F.col("line_no")))
    return _cut(found, lines, low, high)


def _cut(found: DataFrame, lines: DataFrame, low: Column, high: Column) -> DataFrame:
    bounded = found.withColumns({"_low": low, "_high": high}).drop("_first", "_last").join(ends(lines).withColumnRenamed("_last", "_end"), KEY)
    return bounded.withColumn("first_line", F.greatest(F.lit(1), "_low").cast("int")).withColumn("last_line", F.least("_end", "_high").cast("int")).drop("_low", "_high", "_end")


def windows(events: DataFrame, lines: DataFrame, order: list[Column] | None = None, limit: int = SHOWN) -> DataFrame:
    """artifact_id, position, first_line, last_line, line_no, gc_id, kind, more: the first windows around events in order, equal ones once, and whether there are more events.

    ``line_no``, ``gc_id`` and ``kind`` are of the event that a window came from.
    """
    order = order or gc.chronology()
    placed = event_ranges(events, lines).withColumn("_o", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    once = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "first_line", "last_line").orderBy("_o"))).withColumn("_all", F.count("*").over(Window.partitionBy(*KEY))).where("_r = 1")
    numbered = once.withColumn("position", F.row_number().over(Window.partitionBy(*KEY).orderBy("_o"))).where(F.col("position") <= limit)
    shown = F.count("*").over(Window.partitionBy(*KEY))
    return numbered.select(*KEY, "position", "first_line", "last_line", "line_no", "gc_id", "kind", (F.col("_all") > shown).alias("more"))


def _weight() -> Column:
    base = F.greatest(F.lit(1.0), F.coalesce("amount_ms", F.lit(0.0)))
    return base + F.when(F.col("kind") == "signal", F.lit(SIGNAL_WEIGHT)).otherwise(0.0) + F.when(gc.concurrent_phase(), F.lit(CONCURRENT_WEIGHT)).otherwise(0.0)


def _densest(events: DataFrame, weighed: bool) -> DataFrame:
    """The events of each log's densest DENSE_LINES lines: most events, then weight (if it counts), then the fewest lines, then the earliest."""
    by_line = Window.partitionBy(*KEY).orderBy("line_no").rangeBetween(0, DENSE_LINES)
    micro = F.round(_weight() * 1000).cast("long")
    sized = events.where("line_no > 0").select(*KEY, F.col("line_no").alias("_from"), F.count("*").over(by_line).alias("_n"), (F.sum(micro).over(by_line) if weighed else F.lit(0)).alias("_w"), F.max("line_no").over(by_line).alias("_to"))
    best = sized.groupBy(*KEY).agg(F.min_by(F.struct("_from", "_to", "_n"), F.struct(-F.col("_n"), -F.col("_w"), F.col("_to") - F.col("_from"), F.col("_from"))).alias("b")).select(*KEY, "b.*")
    return events.join(best, KEY).where(F.col("line_no").between(F.col("_from"), F.col("_to")))


def _hull(events: DataFrame, slice_id: str | Column) -> DataFrame:
    named = F.lit(slice_id) if isinstance(slice_id, str) else slice_id
    return events.groupBy(*KEY, named.alias("slice_id")).agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("n"))


def incident_slices(events: DataFrame, lines: DataFrame, collectors: DataFrame) -> DataFrame:
    """artifact_id, slice_id, first_line, last_line, n: every incident of every log that has it, with the number of events it came from.

    Incidents of one event are its range: the first by line or the largest by size (ties: the first). The collector's own is the densest
    window of the events that tell its distress, the failure region that of failures (two at least), the tail the last lines.
    """
    amount, occupancy = F.coalesce("amount_ms", F.lit(0.0)), F.coalesce(gc._occupancy(), F.lit(0.0))
    growth = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    full, name = gc.full_gc(), F.col("collector")
    one = (
        ("gc-incident-first-to-space-distress", gc.signal("TO_SPACE_EXHAUSTED") & (name == "G1"), None), ("gc-incident-first-concurrent-mode-failure", gc.signal("CONCURRENT_MODE_FAILURE") & (name == "CMS"), None), ("gc-incident-longest-concurrent-phase", gc.concurrent_phase() & (name == "CMS"), amount), ("gc-incident-first-evacuation-failure", gc.evacuation_failure(), None),
        ("gc-incident-first-full-gc", full & ~name.isin("G1", "CMS", "Serial", "Parallel"), None), ("gc-incident-longest-full-gc", full, amount), ("gc-incident-first-concurrent-abort", gc.signal("CONCURRENT_ABORT"), None), ("gc-incident-first-full-compaction-attempt", gc.signal("FULL_COMPACTION_ATTEMPT"), None),
        ("gc-incident-peak-occupancy", F.col("kind").isin("pause", "cycle") & (occupancy > 0), occupancy), ("gc-incident-longest-allocation-stall", F.col("kind") == "stall", amount), ("gc-incident-peak-humongous-growth", (F.col("kind") == "humongous") & (growth > 0), growth),
    )
    known = events.where("line_no > 0").join(collectors.select(*KEY, "collector"), KEY)
    marked = known.select("*", F.explode(F.filter(F.array(*(F.when(test, F.struct(F.lit(s).alias("slice_id"), (F.lit(0.0) if by is None else by.cast("double")).alias("by"))) for s, test, by in one)), lambda x: x.isNotNull())).alias("s"))
    event = F.struct("line_no", "gc_id", "kind")
    chosen = marked.groupBy(*KEY, "s.slice_id").agg(F.min_by(event, F.struct(-F.col("s.by"), F.col("line_no"), F.coalesce("gc_id", F.lit(-1)))).alias("e")).select(*KEY, "slice_id", "e.*")
    single = _hull(event_ranges(chosen, lines, INCIDENT), F.col("slice_id"))
    own = F.coalesce(*(F.when((name == c) & test, F.lit(BY_COLLECTOR[c])) for c, test in (("G1", gc.distress()), ("CMS", full | gc.signal("CONCURRENT_MODE_FAILURE") | gc.concurrent_phase()), ("Serial", full), ("Parallel", full), ("ZGC", F.col("kind") == "stall"))))
    telling = gc.first_wins(known.withColumn("slice_id", own).where("slice_id IS NOT NULL"))
    dominant = _hull(event_ranges(_densest(telling, True).select(*KEY, "line_no", "gc_id", "kind", "slice_id"), lines, INCIDENT), F.col("slice_id"))
    region = _densest(known.where(gc.distress()), False).where("_n >= 2")
    dense = _cut(region.groupBy(*KEY).agg(F.min("line_no").alias("_a"), F.max("line_no").alias("_b"), F.count("*").alias("n")), lines, F.col("_a") - INCIDENT.pad, F.col("_b") + INCIDENT.pad).select(*KEY, F.lit("gc-incident-densest-failure-region").alias("slice_id"), "first_line", "last_line", "n")
    tail = ends(lines).join(collectors.select(*KEY), KEY).select(*KEY, F.lit("gc-incident-tail").alias("slice_id"), F.greatest(F.lit(1), F.col("_last") - TAIL_LINES + 1).cast("int").alias("first_line"), F.col("_last").cast("int").alias("last_line"), F.lit(0).cast("long").alias("n"))
    return dominant.unionByName(single).unionByName(dense).unionByName(tail)


def incident(events: DataFrame, lines: DataFrame, collectors: DataFrame, wanted: str) -> DataFrame:
    """artifact_id, slice_id, first_line, last_line, n: of the slices that the name may mean the first that a log has; logs without any are left out."""
    order = tried(wanted)
    places = {s: n for n, s in enumerate(order) if s != COLLECTOR}
    place = F.lit(None).cast("int")
    if COLLECTOR in order:
        own = F.coalesce(*(F.when(F.col("collector") == c, F.lit(s)) for c, s in BY_COLLECTOR.items()))
        place = F.when(F.col("slice_id") == own, F.lit(order.index(COLLECTOR)))
    for slice_id, n in places.items():
        place = F.coalesce(place, F.when(F.col("slice_id") == slice_id, F.lit(n)))
    found = incident_slices(events, lines, collectors).join(collectors.select(*KEY, "collector"), KEY).withColumn("_p", place).where("_p IS NOT NULL")
    return found.groupBy(*KEY).agg(F.min_by(F.struct("slice_id", "first_line", "last_line", "n"), "_p").alias("s")).select(*KEY, "s.*")


#: The streaks that can be asked for.
STREAKS = {"full-gc": gc.full_gc, "evacuation-failure": gc.evacuation_failure, "failure": gc.signal, "failure-signal": gc.signal, "distress": gc.distress}


def streak(events: DataFrame, lines: DataFrame, wanted: str) -> DataFrame:
    """As ``windows``: around the heaviest, the first and the last event of the best cluster of a kind of event, in this order, each once."""
    test = STREAKS.get(wanted.strip().lower().replace("_", "-").replace(" ", "-"))
    rows = gc.first_wins(events.where(F.lit(False) if test is None else test()))
    best = gc.cluster_of(rows, KEY).select(*KEY, F.col("first_line").alias("_a"), F.col("last_line").alias("_b"))
    members = gap_clusters(rows, KEY, "elapsed_s", "line_no", gc.GAP_S, gc.GAP_LINES).join(best, KEY).where(F.coalesce("line_no", F.lit(0)).between(F.col("_a"), F.col("_b")))
    clock = gc.chronology()
    back = [c.desc() for c in clock]
    at = lambda *order: F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    ranked = members.withColumns({"_heavy": at(F.round(gc.weight() * 1000).desc(), *back), "_first": at(*clock), "_last": at(*back)})
    role = F.when(F.col("_heavy") == 1, 0).when(F.col("_first") == 1, 1).when(F.col("_last") == 1, 2)
    chosen = ranked.withColumn("_role", role).where("_role IS NOT NULL").drop("_heavy", "_first", "_last", "_a", "_b", "cluster")
    return windows(chosen, lines, [F.col("_role")])


def time_window(events: DataFrame, lines: DataFrame, selector: Selector) -> DataFrame:
    """artifact_id, lo, hi, first_line, last_line, n: the window of seconds that a request means, and the raw lines around all events in it."""
    inside = gc.inside(events, gc.resolve(events, selector))
    return event_ranges(inside.select(*KEY, "lo", "hi", "line_no", "gc_id", "kind"), lines).groupBy(*KEY, "lo", "hi").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("n"))


def events_of(ranges_: DataFrame, events: DataFrame) -> DataFrame:
    """Each range with the events in it, from which it can be told why it is shown."""
    return ranges.points_in(ranges_.select(*KEY, "first_line", "last_line"), events.where("line_no > 0").select(*KEY, "line_no", "gc_id", "kind", gc.named().alias("name"), "amount_ms"))
