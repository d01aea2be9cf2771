"""Retrieval over raw lines and parsed events: an index of slices, windows around evidence, time spans of raw text, and one dispatcher for selectors.

Lines are (artifact_id, line_no, line). Ranges are (artifact_id, first_line, last_line); ranges that meet are one. Numbers of lines, windows and
characters are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators import context
from heapstone.operators.context import Selector
from heapstone.operators.ranges import points_in, text_of
from heapstone.operators.ranking import top_per_group

__all__ = ["text_of"]

KEY = ["artifact_id"]
#: Lines before and after evidence, around an event, before and after a time span; windows shown; the size below which an artifact is shown whole.
EVIDENCE, AROUND, SPAN, SHOWN, SMALL = 5, 2, (5, 10), 3, (16_000, 160)


def ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*KEY).agg(F.max("line_no").alias("_last"))


def clamped(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Ranges cut to their artifact's lines; those outside are left out."""
    cut = ranges.join(ends(lines), KEY)
    return cut.withColumn("first_line", F.greatest(F.lit(1), "first_line")).withColumn("last_line", F.least("_last", "last_line")).where("first_line <= last_line").drop("_last")


def merged(ranges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, first_line, last_line, n: ranges that overlap or follow each other joined, with the number of ranges in each."""
    keys = keys or KEY
    order = Window.partitionBy(*keys).orderBy("first_line", "last_line")
    before = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_b", F.coalesce(F.col("first_line") > before + 1, F.lit(False)).cast("int"))
    numbered = marked.withColumn("_g", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("n")).drop("_g")


def evidence_windows(evidence: DataFrame, lines: DataFrame, width: int = EVIDENCE) -> DataFrame:
    """artifact_id, first_line, last_line, n: lines around each piece of evidence (artifact_id, line_no), merged."""
    spans = evidence.select(*KEY, (F.col("line_no") - width).alias("first_line"), (F.col("line_no") + width).alias("last_line"))
    return merged(clamped(spans, lines))


def event_windows(events: DataFrame, lines: DataFrame, width: int = AROUND, limit: int = SHOWN) -> DataFrame:
    """artifact_id, position, first_line, last_line, n, more: the first windows around matching events, and whether there are others."""
    found = evidence_windows(events, lines, width)
    total = F.count("*").over(Window.partitionBy(*KEY)) > limit
    return top_per_group(found.withColumn("more", total), KEY, [F.col("first_line")], limit)


def gc_id_range(events: DataFrame, lines: DataFrame, anchors: DataFrame, radius: int = 80, width: int = AROUND) -> DataFrame:
    """For each anchor (artifact_id, gc_id, line_no): first and last line of the events of its GC number within ``radius`` lines, widened."""
    near = events.select(*KEY, "gc_id", F.col("line_no").alias("_at")).join(anchors.select(*KEY, "gc_id", "line_no"), [*KEY, "gc_id"]).where(F.abs(F.col("_at") - F.col("line_no")) <= radius)
    spans = near.groupBy(*KEY, "gc_id", "line_no").agg((F.min("_at") - width).alias("first_line"), (F.max("_at") + width).alias("last_line"))
    return clamped(spans, lines)


def time_span(lines: DataFrame, start: str | None, end: str | None, before: int = SPAN[0], after: int = SPAN[1]) -> DataFrame:
    """artifact_id, first_line, last_line: from the first line that holds ``start`` to the last that holds ``end`` (any case); a missing or unmatched end is the other one, widened."""
    hit = lambda token, pick_one: pick_one(F.when(F.lower("line").contains((token or "").lower()), F.col("line_no"))) if token else F.lit(None).cast("int")
    found = lines.groupBy(*KEY).agg(hit(start, F.min).alias("a"), hit(end, F.max).alias("b"), F.max("line_no").alias("_last")).where("a IS NOT NULL OR b IS NOT NULL")
    low, high = F.least(F.coalesce("a", "b"), F.coalesce("b", "a")), F.greatest(F.coalesce("a", "b"), F.coalesce("b", "a"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return found.select(*KEY, F.greatest(F.lit(1), F.when(both, low).otherwise(low - before)).alias("first_line"), F.least("_last", F.when(both, high).otherwise(high + after)).alias("last_line"))


def anchors(lines: DataFrame, points: int = 5) -> DataFrame:
    """artifact_id, line_no: first, last and middle line and ``points`` evenly spaced ones, each once: round(i * (n - 1) / (points - 1)) + 1."""
    wanted = F.array_union(F.array(F.lit(1), F.col("_last").cast("int"), F.floor((F.col("_last") + 1) / 2).cast("int")), F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (F.floor(i * (F.col("_last") - 1) / F.lit(points - 1) + 0.5) + 1).cast("int")))
    return ends(lines).select(*KEY, F.explode(F.array_distinct(wanted)).alias("line_no"))


def is_small(lines: DataFrame) -> DataFrame:
    """artifact_id, chars, n_lines, small: whether an artifact is short enough to be shown whole from the start."""
    sums = lines.groupBy(*KEY).agg((F.sum(F.length("line") + 1) - 1).alias("chars"), F.count("*").alias("n_lines"))
    return sums.withColumn("small", (F.col("chars") <= SMALL[0]) & (F.col("n_lines") <= SMALL[1]))


def index(lines: DataFrame, evidence: DataFrame, header: Column | None = None, size: int = 24) -> DataFrame:
    """artifact_id, slice_id, ordinal, first_line, last_line, kind: an artifact's slices: evidence windows, sections by header, then raw chunks."""
    def numbered(df: DataFrame, prefix: str, kind: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*KEY).orderBy("first_line"))
        return df.withColumn("_k", at).select(*KEY, F.format_string(f"{prefix}-%03d", F.col("_k")).alias("slice_id"), F.lit(kind).alias("kind"), "first_line", "last_line")

    parts = numbered(evidence_windows(evidence, lines), "evidence", "evidence")
    if header is not None:
        named = context.section_of(lines, KEY, header).where("section IS NOT NULL")
        parts = parts.unionByName(numbered(named.groupBy(*KEY, "section").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")), "section", "section"))
    chunks = lines.withColumn("_c", F.floor((F.col("line_no") - 1) / size)).groupBy(*KEY, "_c").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    raw = chunks.select(*KEY, F.format_string("raw-chunk-%03d", F.col("_c") + 1).alias("slice_id"), F.lit("raw").alias("kind"), "first_line", "last_line")
    every = parts.unionByName(raw)
    order = F.when(F.col("kind") == "evidence", 0).when(F.col("kind") == "section", 1).otherwise(2)
    return every.withColumn("ordinal", F.row_number().over(Window.partitionBy(*KEY).orderBy(order, "first_line", "slice_id")))


def slice_by_id(slices: DataFrame, slice_id: str) -> DataFrame:
    return slices.where(F.lower("slice_id") == slice_id.strip().lower())


def first_block(slices: DataFrame, lines: DataFrame, text: str) -> DataFrame:
    """The first slice of each artifact that holds a text (any case)."""
    hits = lines.where(F.lower("line").contains(text.lower())).select(*KEY, "line_no")
    inside = points_in(slices, hits)
    return inside.groupBy(*KEY).agg(F.min_by(F.struct("slice_id", "kind", "first_line", "last_line"), "ordinal").alias("s")).select(*KEY, "s.*")


def asked_lines(selector: Selector) -> tuple[int, int] | None:
    """First and last line that a request names, in order; None where they are no numbers."""
    first, _, last = (selector.get("lines") or f"{selector.get('startLine', 'lineStart')}-{selector.get('endLine', 'lineEnd') or ''}").partition("-")
    try:
        low, high = sorted((int(first), int(last or first)))
    except ValueError:
        return None
    return low, high


def retrieve(lines: DataFrame, slices: DataFrame, events: DataFrame, selector: Selector, seen: DataFrame | None = None, collectors: DataFrame | None = None) -> tuple[str, DataFrame]:
    """What a selector asks for, and the ranges: slice, incident, lines, section, streak, a window of seconds, events by cause, phase, signal or GC number, a time span, a pattern, else the next unseen slice.

    Incidents need ``collectors`` (artifact_id, collector). A request that names no line (``lines=abc``) or an unknown incident gets no rows.
    """
    from heapstone.views import gc_ranges

    shown = ["artifact_id", "first_line", "last_line"]
    if selector.get("slice", "sliceId"):
        return "slice", slice_by_id(slices, selector.get("slice", "sliceId")).select(*shown)
    if selector.get("incident") and collectors is not None:
        return "incident", gc_ranges.incident(events, lines, collectors, selector.get("incident")).select(*shown)
    if selector.get("lines", "startLine", "lineStart"):
        low, high = asked_lines(selector) or (1, 0)
        return "lines", clamped(ends(lines).select(*KEY, F.lit(low).alias("first_line"), F.lit(high).alias("last_line")), lines).select(*shown)
    if selector.get("section"):
        return "section", first_block(slices.where("kind = 'section'"), lines, selector.get("section")).select(*shown)
    if selector.get("streak", "streakKind"):
        return "streak", gc_ranges.streak(events, lines, selector.get("streak", "streakKind")).select(*shown)
    if selector.number("windowSeconds") is not None:
        return "window", gc_ranges.time_window(events, lines, selector).select(*shown)
    columns = {"cause": "cause", "pausetype": "pause_type", "phase": "phase", "phasekind": "phase_kind", "signaltype": "signal_type", "thread": "thread"}
    if any(k in selector.values for k in columns):
        return "events", event_windows(events.where(selector.matching(columns)), lines).select(*shown)
    if selector.number("gcId") is not None:
        return "gc-id", event_windows(events.where(F.col("gc_id") == int(selector.number("gcId"))), lines).select(*shown)
    if selector.get("start") or selector.get("end"):
        return "time", time_span(lines, selector.get("start"), selector.get("end")).select(*shown)
    if selector.get("pattern"):
        return "pattern", context.pattern_windows(lines, KEY, selector.get("pattern")).select(*shown).distinct()
    left = slices if seen is None else slices.join(seen.select(*KEY, "slice_id"), [*KEY, "slice_id"], "left_anti")
    return "next", left.groupBy(*KEY).agg(F.min_by(F.struct("first_line", "last_line"), "ordinal").alias("s")).select(*KEY, "s.*")
