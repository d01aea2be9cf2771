"""GC logs: lines to event tables, event tables to one summary row for each artifact. Column expressions only.

Every table carries artifact_id, line_no, raw_line, elapsed_s, abs_ts and gc_id. Unified logs (JDK 9 and up) and older ones are read.
Each kind of event is a test of a line and the columns it yields. ``events`` puts all kinds into one wide table in a single pass over the
lines; the functions named after a kind give that kind alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.functions.scalars import found, number, size_bytes
from heapstone.operators.ordered import nearest_rank
from heapstone.operators.ranking import merged, ratio
from heapstone.sources.stored import stored


def _line() -> Column:
    return F.col("line")


def _shows(*texts: str) -> Column:
    """Whether a line holds one of some texts: what a pattern implies is looked for first, as most lines don't have it."""
    return reduce(Column.__or__, map(_line().contains, texts))


#: Parts of patterns: a size with unit, a heap transition "before->after(capacity)".
SIZE = r"(\d+(?:\.\d+)?)([BKMGT]?)"
CHANGE = SIZE + r"->" + SIZE + r"\(" + SIZE + r"\)"
#: Occupancy that counts as high and as near capacity; share of the heap that counts as little reclaimed.
HIGH, NEAR, LITTLE = 0.85, 0.95, 0.05
#: Failure signals: name and the text that tells it, in order.
SIGNALS = (
    ("CONCURRENT_ABORT", "concurrent mark abort"),
    ("TO_SPACE_EXHAUSTED", "to-space exhausted"),
    ("TO_SPACE_EXHAUSTED", "evacuation failure"),
    ("FULL_COMPACTION_ATTEMPT", "full compaction attempt"),
    ("CONCURRENT_MODE_FAILURE", "concurrent mode failure"),
    ("PROMOTION_FAILED", "promotion failed"),
)


#: Collectors and the texts that tell them, the first that fits.
COLLECTORS = (
    ("ZGC", ("z garbage collector", "using zgc")), ("G1", ("using g1", "g1 evacuation pause", "g1 compaction pause", "garbage-first")),
    ("CMS", ("concurrent mark sweep", "[gc,cms", "cms initial mark", "cms final remark", "cms-remark", "cms-concurrent", "parnew", "[cms:", "concurrent mode failure")),
    ("Parallel", ("parallel gc", "parallel scavenge", "using parallel", "psyounggen", "paroldgen", "ps old gen", "parallel old")), ("Serial", ("serial gc", "using serial", "defnew", "serial old", "tenured generation", "tenured:", "marksweepcompact")),
)


def gc_lines(lines: DataFrame, *more: str) -> DataFrame:
    """Lines with their clocks and GC number, and ``more`` of their columns."""
    elapsed = F.coalesce(number(_line(), r"\[(\d+\.\d+)s\]"), number(_line(), r"^(?:\S+[+-]\d{4}: )?(\d+\.\d{3}): \["))
    stamp = F.coalesce(found(_line(), r"^\[?(\d{4}-\d{2}-\d{2}T[\d:.,]+[+-]\d{2}:?\d{2})"), found(_line(), r"^(\d{4}-\d{2}-\d{2}T[\d:.,]+Z?)"))
    return lines.select("artifact_id", "line_no", "line", F.trim("line").alias("raw_line"), elapsed.alias("elapsed_s"), stamp.alias("abs_ts"), number(_line(), r"GC\((\d+)\)", 1, "long").alias("gc_id"), *more)


def pause_type(event: Column) -> Column:
    """First kind that the event's text shows."""
    return _pause_type(_plain(event))


def _plain(event: Column) -> Column:
    return F.translate(F.lower(event), "-", " ")


def _pause_type(low: Column) -> Column:
    order = (("FULL", "full"), ("DEGENERATED", "degenerated"), ("INIT_MARK", "init mark"), ("INIT_MARK", "initial mark"), ("FINAL_MARK", "final mark"), ("REMARK", "remark"), ("CLEANUP", "cleanup"), ("MIXED", "mixed"), ("YOUNG", "young"), ("UPDATE_REFS", "update refs"))
    kind = F.lit("OTHER")
    for name, text in reversed(order):
        kind = F.when(low.contains(text), F.lit(name)).otherwise(kind)
    return kind


def cause(event: Column) -> Column:
    """The last text in parentheses, else the event itself."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(event, F.lit(r"\(([^()]+)\)"), F.lit(1)), F.lit(-1)), event)


def _block_header() -> Column:
    """A pause of the old G1 collector whose line holds no heap change: that is in its details, if there are any."""
    return _shows("[GC pause (") & ~_line().rlike(r"->\s*\d")


def _block_detail() -> Column:
    return F.substring(_line(), 1, 1).rlike(r"[\s,\[]") & _line().rlike(r"^\s+\S|^, \d+\.\d+ secs\]|^\[Times")


def legacy_blocks(lines: DataFrame) -> DataFrame:
    """Old G1 pauses run over several lines: the header ``GC pause (...)``, indented details, the closing times. One row with the joined text each.

    A block goes from a header to the line before the next one that isn't indented, detail or closing; a header without details is a block too.
    Only such lines are ordered, of which logs in the unified format have next to none; a break in their numbers ends a block.
    """
    header = _block_header()
    detail = _block_detail()
    order = Window.partitionBy("artifact_id").orderBy("line_no")
    runs = lines.where(header | detail).withColumn("_h", header.cast("int")).withColumn("_gap", ((F.col("line_no") - F.lag("line_no").over(order) > 1) & (F.col("_h") == 0)).cast("int"))
    numbered = runs.withColumn("_block", F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_block > 0")
    inside = numbered.withColumn("_off", F.sum("_gap").over(Window.partitionBy("artifact_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).where("_off = 0")
    joined = inside.groupBy("artifact_id", "_block").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return joined.drop("_block")


def _heap(text: Column) -> dict[str, Column]:
    """The sizes of a heap change in bytes: the three are found by one match.

    They are taken by a function on arrays, which also keeps Spark from making one method of all FIELDS: the JVM doesn't compile one of that size.
    """
    amount = lambda x: F.rtrim(x, F.lit("BKMGT"))
    sizes = F.transform("_sizes", lambda x: size_bytes(amount(x).try_cast("double"), F.substr(x, F.length(amount(x)) + 1)))
    return {"_sizes": F.split(F.regexp_replace(text, CHANGE, "$1$2,$3$4,$5$6"), ","), **{name: F.try_element_at(sizes, F.lit(k)) for k, name in enumerate(("before_bytes", "after_bytes", "capacity_bytes"), 1)}}


#: A kind's name, the test of its lines, its columns. Names in PARTS are what other columns are taken from, each found once; _plain is the event's text in small letters.
Kind = tuple[str, Column, dict[str, Column]]
PARTS = {"_event": "string", "_body": "string", "_sizes": "array<string>"}

#: Columns of ``events`` beside the context: the kinds' own columns, null where a kind has none.
FIELDS = {
    "event": "string", "cause": "string", "pause_type": "string", "amount_ms": "double", "before_bytes": "long", "after_bytes": "long", "capacity_bytes": "long", "before_ratio": "double", "after_ratio": "double",
    "thread": "string", **{f"mmu_{ms}ms": "double" for ms in (2, 5, 10, 20, 50, 100)}, "active": "long", "available": "long", "purpose": "string", "user_s": "double", "sys_s": "double", "real_s": "double", "before": "long", "after": "long",
    "phase": "string", "phase_kind": "string", "signal_type": "string", "signal": "string", "used_kb": "long", "committed_kb": "long", "reserved_kb": "long",
}


def _pause_kinds() -> list[Kind]:
    """Pauses on one line: unified logs, then older ones."""
    event = F.trim(F.regexp_extract(_line(), r"\b(Pause .*?)\s*(?:" + CHANGE + r"\s*)?\d+\.\d+ms\s*$", 1))
    known = F.col("_event")
    new = {"_event": event, "event": known, "cause": cause(known), "pause_type": _pause_type(F.col("_plain")), "amount_ms": number(_line(), r"(\d+\.\d+)ms\s*$"), **_heap(F.regexp_extract(_line(), CHANGE, 0))}
    old_event = F.trim(F.regexp_extract(_line(), r"\[((?:Full )?GC(?: \([^)]*\)|--| pause|\s\([^\[]*\))*)", 1))
    text = F.coalesce(F.when(_line().rlike(r"\] +\d+[KMG]->"), F.regexp_extract(_line(), r"\] +(\d+[KMG]->\d+[KMG]\(\d+[KMG]\))", 1)), F.try_element_at(F.regexp_extract_all(_line(), F.lit(r"\d+[KMG]->\d+[KMG]\(\d+[KMG]\)"), F.lit(0)), F.lit(-1)), F.lit(""))
    old_type = F.when(known.startswith("Full"), "FULL").when(_line().contains("initial-mark") | _line().contains("Initial Mark"), "INIT_MARK").when(_line().contains("Remark"), "REMARK").when(_line().contains("mixed"), "MIXED").otherwise("YOUNG")
    old = {"_event": old_event, "event": known, "cause": cause(known), "pause_type": old_type, "amount_ms": number(_line(), r", (\d+\.\d+) secs\](?: \[Times.*)?\s*$") * 1000, **_heap(text)}
    return [
        ("pause", _shows("Pause ") & _line().rlike(r"\bPause .*\d+\.\d+ms\s*$"), new),
        ("pause", _shows(" secs]") & _line().rlike(r"\[(?:Full )?GC\b.*, \d+\.\d+ secs\](?: \[Times.*)?\s*$") & ~_line().contains("[gc") & ~_block_header(), old),
    ]


def _block_pauses(lines: DataFrame) -> DataFrame:
    """Pauses of the old G1 collector that run over several lines, as rows of ``events``."""
    b = F.col("text")
    event = F.trim(F.regexp_extract(b, r"\[(GC pause (?:\([^)]*\) ?)+)", 1))
    heap = r"Heap:\s*" + SIZE + r"\(" + SIZE + r"\)->" + SIZE + r"\(" + SIZE + r"\)"
    size = lambda k: size_bytes(number(b, heap, k), F.regexp_extract(b, heap, k + 1))
    columns = {"event": event, "cause": cause(event), "pause_type": pause_type(event), "amount_ms": number(b, r", (\d+\.\d+) secs\]") * 1000, "before_bytes": size(1), "after_bytes": size(5), "capacity_bytes": size(7)}
    rows = legacy_blocks(lines).select("artifact_id", "line_no", F.lit(None).cast("long").alias("gc_id"), number(b, r"(\d+\.\d{3}): \[GC pause").alias("elapsed_s"), found(b, r"^(\d{4}-\d{2}-\d{2}T\S+?): ").alias("abs_ts"), F.trim(F.element_at(F.split(b, "\n"), 1)).alias("raw_line"), _wide("pause", columns).alias("e"))
    return rows.where("e.amount_ms IS NOT NULL")


def _wide(kind: str, columns: dict[str, Column]) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *(columns.get(name, F.lit(None)).cast(kind_of).alias(name) for name, kind_of in FIELDS.items()))


def _cycle_kind() -> Kind:
    pattern = r"\b((?:Garbage Collection|Minor Collection|Major Collection) \(([^)]*)\)) " + SIZE + r"\((\d+)%\)->" + SIZE + r"\((\d+)%\)(?: (\d+\.\d+)(ms|s))?"
    part = lambda k, kind="double": number(_line(), pattern, k, kind)
    duration = F.when(F.regexp_extract(_line(), pattern, 10) == "s", part(9) * 1000).otherwise(part(9))
    return "cycle", _shows("Collection (") & _line().rlike(pattern), {
        "event": found(_line(), pattern, 1), "cause": found(_line(), pattern, 2), "amount_ms": duration, "before_bytes": size_bytes(part(3), F.regexp_extract(_line(), pattern, 4)), "before_ratio": part(5) / 100, "after_bytes": size_bytes(part(6), F.regexp_extract(_line(), pattern, 7)), "after_ratio": part(8) / 100,
    }


def _stall_kind() -> Kind:
    pattern = r"Allocation Stall \(([^)]*)\) (\d+\.\d+)ms"
    return "stall", _shows("Allocation Stall (") & _line().rlike(pattern), {"thread": found(_line(), pattern, 1), "amount_ms": number(_line(), pattern, 2)}


def _mmu_kind() -> Kind:
    return "mmu", _shows("MMU: ") & _line().rlike(r"\bMMU: "), {f"mmu_{ms}ms": number(_line(), rf"\b{ms}ms/(\d+(?:\.\d+)?)%") for ms in (2, 5, 10, 20, 50, 100)}


def _worker_kind() -> Kind:
    pattern = r"Using (\d+)(?: workers)?(?: of (\d+))?(?: workers)?(?: for ([\w -]+?))?\s*$"
    return "worker", _shows("Using ") & _line().rlike(r"\bUsing \d+ (?:workers|of)"), {"active": number(_line(), pattern, 1, "long"), "available": number(_line(), pattern, 2, "long"), "purpose": found(_line(), pattern, 3)}


def _cpu_kind() -> Kind:
    seconds = {f"{name}_s": number(_line(), rf"(?i)\b{name}=(\d+\.\d+)") for name in ("user", "sys", "real")}
    return "cpu", _shows("=") & _line().rlike(r"(?i)user=\d+\.\d+s? sys=\d+\.\d+s?,? real=\d+\.\d+"), seconds


def _humongous_kind() -> Kind:
    pattern = r"Humongous regions: (\d+)->(\d+)"
    return "humongous", _shows("Humongous regions: ") & _line().rlike(pattern), {"before": number(_line(), pattern, 1, "long"), "after": number(_line(), pattern, 2, "long")}


def _phase_kinds() -> list[Kind]:
    """Timed parts of a collection that are neither pauses with a heap change nor cycles: unified logs, then older ones."""
    pattern = r"\b(?:Phase \d+: )?([A-Z][\w():,/ -]*?):? (\d+\.\d+)ms\s*$"
    legacy = r"\[(CMS-concurrent-[\w-]+): [\d.]+/(\d+\.\d+) secs\]|\[GC (concurrent-[\w-]+-end), (\d+\.\d+) secs\]"
    body = F.regexp_replace(_line(), r"^(?:.*?GC\(\d+\)\s+|(?!.*GC\(\d+\)\s).*\]\s*)", "")
    known, old_name = F.col("_event"), F.coalesce(found(_line(), legacy, 1), found(_line(), legacy, 3))
    seconds = F.coalesce(number(_line(), legacy, 2), number(_line(), legacy, 4))
    some = _line().contains("phases") | _line().contains("marking") | _line().contains("Concurrent")
    unified = _line().contains("[gc") & some & ~_line().contains("->") & ~_line().contains("Allocation Stall") & _line().rlike(r"\d\.\d+ms\s*$") & (F.trim(F.regexp_extract(body, pattern, 1)) != "")
    return [
        ("phase", unified, {"_body": body, "_event": F.trim(F.regexp_extract(body, pattern, 1)), "phase": known, "phase_kind": _phase_kind(known), "amount_ms": number(F.col("_body"), pattern, 2)}),
        ("phase", _shows("concurrent-") & _line().rlike(legacy), {"_event": old_name, "phase": known, "phase_kind": _phase_kind(known), "amount_ms": seconds * 1000}),
    ]


def _phase_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("concurrent") | low.startswith("cms-concurrent"), "CONCURRENT").when(low.startswith("pause"), "PAUSE_PHASE").when(low.startswith("phase "), "FULL_GC_PHASE").when(low.contains("evacuate") | low.contains("heap roots") | (low == "other"), "PAUSE_BREAKDOWN").otherwise("OTHER")


def _signal_kind() -> Kind:
    """Signs of distress: the first kind that a line shows."""
    low, kind = F.lower(_line()), F.lit(None).cast("string")
    for name, text in reversed(SIGNALS):
        kind = F.when(low.contains(text), F.lit(name)).otherwise(kind)
    return "signal", reduce(Column.__or__, (F.col("_low").contains(text) for _, text in SIGNALS)), {"signal_type": kind, "signal": F.trim("line")}


def _metaspace_kind() -> Kind:
    """Metaspace after a collection, in KB."""
    unified = r"\bMetaspace: \d+K(?:\(\d+K\))?->(\d+)K\((\d+)K\)"
    legacy = r"\[(?:Metaspace|PSPermGen|Perm ?): \d+K->(\d+)K\((\d+)K\)\]"
    heap = r"\bMetaspace\s+used (\d+)K,(?: capacity \d+K,)? committed (\d+)K, reserved (\d+)K"
    part = lambda k: F.coalesce(number(_line(), unified, k, "long"), number(_line(), heap, k, "long"), number(_line(), legacy, k, "long"))
    return "metaspace", _shows("Metaspace", "Perm") & (_line().rlike(unified) | _line().rlike(legacy) | _line().rlike(heap)), {"used_kb": part(1), "committed_kb": part(2), "reserved_kb": number(_line(), heap, 3, "long")}


def _kinds() -> list[Kind]:
    return [*_pause_kinds(), _cycle_kind(), _stall_kind(), _mmu_kind(), _worker_kind(), _cpu_kind(), _humongous_kind(), *_phase_kinds(), _signal_kind(), _metaspace_kind()]


#: The kind that lines of pauses over several lines bear until they are joined, with their whole text as ``raw_line``.
BLOCK = "block"


def _single(lines: DataFrame, chosen: list[Kind], blocks: bool) -> DataFrame:
    """Events of one line: context, kind, FIELDS, raw_line. With ``blocks`` the lines of pauses over several lines too, by themselves.

    Tests of kinds come first; clocks, and the columns of the one kind that a line is of, are taken from lines that are of some.
    """
    tests = [*(test for _, test, _ in chosen), *([_block_header() | _block_detail()] if blocks else [])]
    hits = F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in enumerate(tests))))
    shown = lines.select("artifact_id", "line_no", "line", F.lower("line").alias("_low"))
    hit = gc_lines(shown.select("artifact_id", "line_no", "line", F.explode_outer(hits).alias("_k")).where("_k IS NOT NULL"), "_k")  # outer, or the optimizer tests every line again

    def of_kind(name: str, kind_of: str = "string") -> Column:
        own = [F.when(F.col("_k") == k, columns[name].cast(kind_of)) for k, (_, _, columns) in enumerate(chosen) if name in columns]
        return (F.coalesce(*own) if own else F.lit(None).cast(kind_of)).alias(name)

    named = F.element_at(F.array(*(F.lit(kind) for kind, _, _ in chosen), F.lit(BLOCK)), F.col("_k") + 1).alias("kind")
    raw = F.when(F.col("_k") == len(chosen), F.col("line")).otherwise(F.col("raw_line")).alias("raw_line")
    hit = hit.select("*", *(of_kind(part, kind_of) for part, kind_of in PARTS.items())).withColumn("_plain", _plain(F.col("_event")))
    return hit.select(*CONTEXT, named, *(of_kind(name, kind_of) for name, kind_of in FIELDS.items()), raw)


CONTEXT = ("artifact_id", "line_no", "gc_id", "elapsed_s", "abs_ts")


def _joined_blocks(lines: DataFrame) -> DataFrame:
    return _block_pauses(lines).select(*CONTEXT, "e.kind", *(f"e.{name}" for name in FIELDS), "raw_line")


def events(lines: DataFrame, kinds: list[Kind] | None = None) -> DataFrame:
    """Every event of all ``kinds``: context, kind and FIELDS. A line may be several events (a failed pause is a pause and a signal)."""
    chosen = _kinds() if kinds is None else kinds
    every = _single(lines, chosen, False)
    return every.unionByName(_joined_blocks(lines)) if any(kind == "pause" for kind, _, _ in chosen) else every


def stored_events(lines: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """The events of all kinds as a table in the shared folder, for results that read them more than once; ``only`` some of their columns, if given.

    The lines are read once: those of pauses over several lines are stored beside the events, and joined from there.
    """
    rows = _single(lines, _kinds(), True)
    names = list(rows.columns if only is None else only)
    block = F.col("kind") == BLOCK
    raw = F.col("raw_line") if "raw_line" in names else F.when(block, F.col("raw_line"))
    held = stored(rows.select(*dict.fromkeys(["artifact_id", "line_no", "kind", *(c for c in names if c != "raw_line")]), raw.alias("raw_line")), "gc-events")
    joined = stored(_joined_blocks(held.where(block).select("artifact_id", "line_no", F.col("raw_line").alias("line"))).select(*names), "gc-blocks")
    return held.where(~block).select(*names).unionByName(joined)


def _only(df: DataFrame, kind: str, *columns: str | Column) -> DataFrame:
    return df.where(F.col("kind") == kind).select("artifact_id", "line_no", "gc_id", "elapsed_s", "abs_ts", *columns, "raw_line")


def pauses_of(found_events: DataFrame) -> DataFrame:
    """Stop-the-world pauses: event, cause, pause_type, pause_ms, heap before, after and capacity in bytes, MB and ratios (null where unknown)."""
    every = _only(found_events, "pause", "event", "cause", "pause_type", F.col("amount_ms").alias("pause_ms"), "before_bytes", "after_bytes", "capacity_bytes")
    mb = lambda c: F.floor(F.col(c) / 1048576 + 0.5).cast("long")
    known = F.col("capacity_bytes") > 0
    return every.withColumns({"before_mb": mb("before_bytes"), "after_mb": mb("after_bytes"), "capacity_mb": mb("capacity_bytes"), "before_ratio": F.when(known, F.col("before_bytes") / F.col("capacity_bytes")), "after_ratio": F.when(known, F.col("after_bytes") / F.col("capacity_bytes"))})


def cycles_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "cycle", "event", "cause", F.col("amount_ms").alias("duration_ms"), "before_bytes", "before_ratio", "after_bytes", "after_ratio")


def stalls_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "stall", "thread", F.col("amount_ms").alias("stall_ms"))


def workers_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "worker", "active", "available", F.when(F.col("available") > 0, F.col("active") / F.col("available")).alias("utilization"), "purpose")


def cpu_of(found_events: DataFrame) -> DataFrame:
    spent = F.col("user_s") + F.col("sys_s")
    return _only(found_events, "cpu", "user_s", "sys_s", "real_s", spent.alias("cpu_s"), F.when(F.col("real_s") > 0, spent / F.col("real_s")).alias("cpu_to_wall"))


def humongous_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "humongous", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def phases_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "phase", "phase", "phase_kind", F.col("amount_ms").alias("duration_ms"))


def signals_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "signal", "signal_type", "signal")


def metaspace_of(found_events: DataFrame) -> DataFrame:
    return _only(found_events, "metaspace", "used_kb", "committed_kb", "reserved_kb", ratio(F.col("used_kb"), F.col("committed_kb")).alias("usage_ratio"))


def pauses(lines: DataFrame) -> DataFrame:
    """Stop-the-world pauses; see ``pauses_of``."""
    return pauses_of(events(lines, _pause_kinds()))


def cycles(lines: DataFrame) -> DataFrame:
    """Whole collections of concurrent collectors, with heap use before and after in percent of the capacity."""
    return cycles_of(events(lines, [_cycle_kind()]))


def stalls(lines: DataFrame) -> DataFrame:
    """Threads that waited for memory."""
    return stalls_of(events(lines, [_stall_kind()]))


def mmu(lines: DataFrame) -> DataFrame:
    """Least mutator utilization in percent over 2 to 100 ms."""
    return _only(events(lines, [_mmu_kind()]), "mmu", *(f"mmu_{ms}ms" for ms in (2, 5, 10, 20, 50, 100)))


def workers(lines: DataFrame) -> DataFrame:
    """Workers in use, those available, their share, and what for."""
    return workers_of(events(lines, [_worker_kind()]))


def cpu(lines: DataFrame) -> DataFrame:
    """User, system and real seconds of a collection; cpu to wall is null without wall time."""
    return cpu_of(events(lines, [_cpu_kind()]))


def humongous(lines: DataFrame) -> DataFrame:
    return humongous_of(events(lines, [_humongous_kind()]))


def phases(lines: DataFrame) -> DataFrame:
    """Timed parts of collections, with their kind."""
    return phases_of(events(lines, _phase_kinds()))


def signals(lines: DataFrame) -> DataFrame:
    """Signs of distress."""
    return signals_of(events(lines, [_signal_kind()]))


def metaspace(lines: DataFrame) -> DataFrame:
    """Metaspace after a collection, in KB; usage is of the committed size."""
    return metaspace_of(events(lines, [_metaspace_kind()]))


def collectors(artifacts: DataFrame) -> DataFrame:
    """artifact_id, collector."""
    low = F.lower("content")
    has = lambda *t: sum((low.contains(x).cast("int") for x in t), F.lit(0)) > 0
    name = F.lit("UNKNOWN")
    for collector, texts in reversed(COLLECTORS):
        name = F.when(has(*texts), F.lit(collector)).otherwise(name)
    return artifacts.select("artifact_id", name.alias("collector"))


def _near(c: str, at: float) -> Column:
    return F.coalesce(F.col(c) >= at, F.lit(False))


def _full() -> Column:
    return F.col("pause_type") == "FULL"


def _evacuation_failure() -> Column:
    return F.lower("event").contains("evacuation failure") | F.lower("raw_line").contains("to-space exhausted")


def _weak_full() -> Column:
    little = (F.col("before_bytes") - F.col("after_bytes") <= LITTLE * F.col("capacity_bytes")) & (F.col("after_ratio") >= HIGH)
    return _full() & F.coalesce(little, F.lit(False))


def _reclaimed_mb() -> Column:
    return F.greatest(F.lit(0), F.col("before_bytes") - F.col("after_bytes")) / 1048576


KEY, ORDER = ["artifact_id"], ["line_no"]
#: Columns of events that a summary reads.
SUMMED = (
    "artifact_id", "line_no", "kind", "elapsed_s", "event", "cause", "pause_type", "amount_ms", "before_bytes", "after_bytes", "capacity_bytes", "before_ratio", "after_ratio", "active", "available", "user_s", "sys_s", "real_s", "before", "after", "phase_kind", "signal_type", "used_kb", "committed_kb", "raw_line",
)


def summary(artifacts: DataFrame, lines: DataFrame) -> DataFrame:
    """The summary of parsed lines; see ``summary_of``. The typed events are stored once, so lines are parsed once for all that is read from them."""
    return summary_of(collectors(artifacts), stored_events(lines, SUMMED))


def _of(kind: str) -> Column:
    return F.col("kind") == kind


def _sums(e: DataFrame) -> DataFrame:
    """All counts, sums and extremes of an artifact's events, of every kind, in one aggregation."""
    p, c, st, w, u, h, m, s = (_of(k) for k in ("pause", "cycle", "stall", "worker", "cpu", "humongous", "metaspace", "signal"))
    ms, reclaimed = F.col("amount_ms"), _reclaimed_mb()
    mine = lambda test, value: F.when(test, value)
    kind = lambda name: p & (F.col("pause_type") == name)
    full, concurrent = p & _full(), _of("phase") & (F.col("phase_kind") == "CONCURRENT")
    utilization, spent, delta = F.when(F.col("available") > 0, F.col("active") / F.col("available")), F.col("user_s") + F.col("sys_s"), F.col("after") - F.col("before")
    used, at = mine(m, F.col("used_kb")), mine(m, F.col("line_no"))
    timed = p | c | st
    return e.groupBy(*KEY).agg(
        F.count_if(p).alias("pause_count"), F.count_if(full).alias("full_gc_count"), F.avg(mine(p, ms)).alias("average_pause_ms"), F.max(mine(p, ms)).alias("max_pause_ms"), F.sum(mine(p, ms)).alias("total_pause_ms"), F.when(F.count_if(p) > 0, F.coalesce(F.max(mine(full, ms)), F.lit(0.0))).alias("max_full_gc_pause_ms"),
        F.max(mine(p | c, F.greatest("before_ratio", "after_ratio"))).alias("peak_occupancy_ratio"), F.max(mine(p, F.col("after_ratio"))).alias("peak_post_gc_occupancy_ratio"), F.avg(mine(p, F.col("after_ratio"))).alias("average_post_gc_occupancy_ratio"), F.count_if(p & _evacuation_failure()).alias("evacuation_failure_pause_count"),
        F.count_if(full & F.lower("cause").contains("metadata")).alias("metaspace_full_gc_count"), F.count_if(p & _near("after_ratio", HIGH)).alias("high_retained_count"), F.count_if(p & _near("after_ratio", NEAR)).alias("near_capacity_count"), F.avg(mine(p, reclaimed)).alias("average_reclaimed_mb"),
        F.count_if(kind("YOUNG")).alias("young_count"), F.count_if(kind("MIXED")).alias("mixed_count"), F.avg(mine(full, F.col("after_ratio"))).alias("average_full_post_gc_occupancy_ratio"), F.avg(mine(kind("MIXED"), F.col("after_ratio"))).alias("average_mixed_post_gc_occupancy_ratio"),
        F.count_if(p & _weak_full()).alias("low_reclaim_full_count"), F.avg(mine(full, reclaimed)).alias("average_full_gc_reclaimed_mb"), F.avg(mine(full, F.greatest(F.lit(0), F.col("before_bytes") - F.col("after_bytes")) / F.col("capacity_bytes"))).alias("average_full_gc_reclaimed_share"), F.count_if(kind("MIXED") & _near("after_ratio", HIGH)).alias("high_retained_mixed_count"),
        F.count_if(s).alias("failure_signal_count"), *(F.count_if(s & (F.col("signal_type") == k)).alias(f"{k.lower()}_count") for k in dict.fromkeys(k for k, _ in SIGNALS)), F.count_if(concurrent).alias("concurrent_phase_count"), F.max(mine(concurrent, ms)).alias("longest_concurrent_phase_ms"),
        F.count_if(c).alias("gc_cycle_count"), F.max(mine(c, ms)).alias("longest_cycle_ms"), F.count_if(st).alias("allocation_stall_count"), F.max(mine(st, ms)).alias("max_allocation_stall_ms"), F.sum(mine(st, ms)).alias("total_allocation_stall_ms"),
        F.count_if(w).alias("worker_sample_count"), F.max(mine(w, F.col("active"))).alias("max_active_workers"), F.min(mine(w, F.col("active"))).alias("min_active_workers"), F.max(mine(w, utilization)).alias("peak_worker_utilization"),
        F.count_if(u).alias("cpu_sample_count"), F.max(mine(u, F.col("real_s"))).alias("max_cpu_real_s"), F.max(mine(u, F.when(F.col("real_s") > 0, spent / F.col("real_s")))).alias("peak_cpu_to_wall"),
        F.count_if(h).alias("humongous_sample_count"), F.max(mine(h, F.col("after"))).alias("peak_humongous_after"), F.count_if(h & (delta > 0)).alias("humongous_growth_count"), F.max(mine(h, delta)).alias("humongous_max_growth"),
        F.count_if(m).alias("metaspace_snapshot_count"), F.max(mine(m, ratio(F.col("used_kb"), F.col("committed_kb")))).alias("peak_metaspace_usage_ratio"), F.max_by(used, at).alias("latest_metaspace_used_kb"), (F.max_by(used, at) - F.min_by(used, at)).alias("metaspace_growth_kb"),
        ((F.max(mine(timed, F.col("elapsed_s"))) - F.min(mine(timed, F.col("elapsed_s")))) * 1000).alias("log_window_ms"),
    )


def _ordered(p: DataFrame) -> DataFrame:
    """Streaks and progression of an artifact's pauses, from running counts in one order of its lines.

    A streak at a row is the count of its flag less that count at the last row which broke it. G1's way to full collections is told by what was
    counted at the first mixed and the first full pause.
    """
    order = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    full, weak = F.coalesce(_full(), F.lit(False)), _weak_full()
    flags = {"near_capacity_streak": (_near("after_ratio", NEAR), None), "full_gc_streak": (full, None), "evacuation_failure_streak": (F.coalesce(_evacuation_failure(), F.lit(False)), None), "low_reclaim_full_streak": (F.coalesce(weak, F.lit(False)), full)}
    marked = p.select(*KEY, "line_no", "pause_type", *(flag.alias(name) for name, (flag, _) in flags.items()), *((within if within is not None else F.lit(True)).alias(f"in_{name}") for name, (_, within) in flags.items()))
    kinds = ("YOUNG", "MIXED", "FULL")
    counted = marked.select("*", *(F.sum(F.col(name).cast("long")).over(order).alias(f"c_{name}") for name in flags), *(F.sum((F.col("pause_type") == k).cast("long")).over(order).alias(f"n_{k}") for k in kinds), F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)).alias("_i"))
    since = counted.select("*", *(F.max(F.when(F.col(f"in_{name}") & ~F.col(name), F.col(f"c_{name}"))).over(order).alias(f"b_{name}") for name in flags))
    at_first = lambda count, kind: F.coalesce(F.min_by(F.when(F.col("pause_type") == kind, F.col(f"n_{count}")), F.when(F.col("pause_type") == kind, F.col("_i"))), F.lit(0))
    any_mixed = F.count_if(F.col("pause_type") == "MIXED") > 0
    return since.groupBy(*KEY).agg(
        *(F.max(F.when(F.col(name), F.col(f"c_{name}") - F.coalesce(f"b_{name}", F.lit(0))).otherwise(F.lit(0))).alias(name) for name in flags),
        at_first("YOUNG", "MIXED").alias("young_before_first_mixed_count"), at_first("MIXED", "FULL").alias("mixed_before_first_full_count"),
        F.when(any_mixed, F.coalesce(F.max("n_FULL"), F.lit(0)) - at_first("FULL", "MIXED")).otherwise(F.lit(0)).alias("full_after_mixed_count"),
    )


def _dominant_causes(p: DataFrame) -> DataFrame:
    """The cause of most pauses and that of most time; ties go to the one seen first, then to the greater name."""
    sums = p.where(F.col("cause").isNotNull()).groupBy(*KEY, "cause").agg(F.count("*").alias("n"), F.sum("amount_ms").alias("ms"), (-F.min("line_no")).alias("first"))
    return sums.groupBy(*KEY).agg(F.max_by("cause", F.struct("n", "first", "cause")).alias("dominant_cause_by_count"), F.max_by("cause", F.struct("ms", "first", "cause")).alias("dominant_cause_by_total_ms"))


def summary_of(collector: DataFrame, e: DataFrame) -> DataFrame:
    """One wide row for each artifact: counts, durations, nearest-rank percentiles, occupancy, streaks, progression; what rules read.

    The log's window goes from the first to the last elapsed time over pauses, cycles and stalls. An artifact without events of a kind has 0
    or null there. ``e`` is read four times, so it should be stored.
    """
    known = _of("pause") & (F.col("capacity_bytes") > 0)
    own = lambda c: F.when(_of("pause"), F.when(known, F.col(f"{c}_bytes") / F.col("capacity_bytes"))).otherwise(F.col(f"{c}_ratio"))
    rated = e.withColumns({"before_ratio": own("before"), "after_ratio": own("after")})
    p = rated.where(_of("pause"))
    ranks = nearest_rank(p, KEY, "amount_ms", {"median_pause_ms": 0.5, "p95_pause_ms": 0.95, "p99_pause_ms": 0.99})
    out = merged([collector, _sums(rated), _ordered(p), ranks, _dominant_causes(p)], KEY)
    out = out.withColumn("stop_the_world_pct", ratio(100 * F.col("total_pause_ms"), F.col("log_window_ms")))
    return out.fillna(0, [f.name for f in out.schema if f.name.endswith(("_count", "_streak"))])


def breakdown(p: DataFrame, by: str) -> DataFrame:
    """artifact_id, key, n, total_ms, max_ms by cause or pause_type."""
    return p.where(F.trim(by) != "").groupBy("artifact_id", by).agg(F.count("*").alias("n"), F.sum("pause_ms").alias("total_ms"), F.max("pause_ms").alias("max_ms"))


def all_events(lines: DataFrame) -> DataFrame:
    """The timeline that windows and searches run on: artifact_id, kind, line_no, gc_id, elapsed_s, name, amount_ms of pauses, cycles, stalls, phases and signals."""
    rows = events(lines).where(F.col("kind").isin("pause", "cycle", "stall", "phase", "signal"))
    name = F.coalesce("event", "thread", "phase", "signal_type")
    return rows.select("artifact_id", "kind", "line_no", "gc_id", "elapsed_s", name.alias("name"), F.when(F.col("kind") == "signal", 0.0).otherwise(F.col("amount_ms")).alias("amount_ms"))
