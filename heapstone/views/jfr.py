"""Focused views of recordings over ``heapstone.parse.jfr.timeline``: slices by family, thread, hotspot, class or old object, ranked breakdowns, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.context import Selector
from heapstone.operators.ranking import ratio, top_per_group
from heapstone.parse import jfr

KEY = ["artifact_id"]
RANKED, SAMPLES = 8, 4
#: Other names of families.
ALIASES = {
    "lockContention": ("lock", "locks", "contention", "monitor"), "monitorWait": ("wait", "monitor-wait"), "gcPause": ("gc", "pause", "gc-pause"), "classLoading": ("class-loading", "classes"), "cpuLoad": ("cpu", "cpu-load"), "threadPark": ("park", "thread-park"), "ioLatency": ("io", "i/o", "io-latency"),
    "exceptionBurst": ("exception", "exceptions"), "safepointPause": ("safepoint",), "allocation": ("allocations", "alloc"), "oldObject": ("old-object", "retention"), "executionSample": ("execution", "cpu-sample"),
}


def compact(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def family_matches(query: str) -> Column:
    """Events whose type or family holds the query, compared by letters and digits, or whose family goes by it."""
    plain = "".join(c for c in query.lower() if c.isalnum())
    named = [name for name, others in ALIASES.items() if plain in {"".join(c for c in x if c.isalnum()) for x in others}]
    fits = compact(F.col("event_type")).contains(plain) | compact(F.col("signal_family")).contains(plain)
    return fits | F.col("signal_family").isin(*named) if named else fits


def parse(request: str | None) -> Selector:
    """A selector; free text asks for an event type, a hotspot, a class, an old object and a pattern at once."""
    s = Selector.parse(request)
    free = s.values.get("pattern") if set(s.values) == {"pattern"} else None
    return Selector({**s.values, **dict.fromkeys(("eventtype", "hotspot", "class", "oldobject"), free)}) if free else s


def _contains(column: str, text: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit(""))).contains(text.lower())


def by_family(rows: DataFrame, query: str) -> DataFrame:
    return rows.where(family_matches(query))


def by_thread(rows: DataFrame, query: str) -> DataFrame:
    return rows.where(_contains("thread", query))


def by_hotspot(rows: DataFrame, query: str) -> DataFrame:
    return rows.where(_contains("top_method", query) | _contains("top_stack", query))


def by_class(rows: DataFrame, query: str) -> DataFrame:
    return rows.where((F.col("signal_family") == "allocation") & _contains("class_name", query))


def by_old_object(rows: DataFrame, query: str) -> DataFrame:
    return rows.where((F.col("signal_family") == "oldObject") & (_contains("class_name", query) | _contains("root_type", query) | _contains("root_description", query)))


def ranked(rows: DataFrame, key: str, limit: int = RANKED) -> DataFrame:
    """artifact_id, position, key, n, total_ms, bytes and their shares: the largest by count, bytes, time, then key; blank keys don't count."""
    named = rows.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    sums = named.groupBy(*KEY, key).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.sum("size_bytes").alias("bytes"))
    totals = sums.groupBy(*KEY).agg(F.sum("n").alias("_n"), F.sum("total_ms").alias("_t"), F.sum("bytes").alias("_b"))
    shares = [ratio(F.col(c), F.col(t)).alias(name) for c, t, name in (("n", "_n", "share"), ("total_ms", "_t", "time_share"), ("bytes", "_b", "byte_share"))]
    every = sums.join(totals, KEY).select(*KEY, F.col(key).alias("key"), "n", "total_ms", "bytes", *shares)
    return top_per_group(every, KEY, [F.desc("n"), F.desc("bytes"), F.desc("total_ms"), F.col("key")], limit)


def slice_view(rows: DataFrame) -> DataFrame:
    """A slice's breakdowns in one table: by ``dimension`` event_type, signal_family, thread, top_method, class_name and root_type."""
    parts = [ranked(rows, key).withColumn("dimension", F.lit(key)) for key in ("event_type", "signal_family", "thread", "top_method", "class_name", "root_type")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def time_token(rows: DataFrame, token: str | None) -> DataFrame | None:
    """artifact_id, us: an ISO instant, or an offset from each recording's start: ``250ms``, ``12s`` or plain seconds."""
    text = (token or "").strip().lower()
    if not text:
        return None
    starts = rows.groupBy(*KEY).agg(F.min("start_us").alias("_lo"))
    number = text.removesuffix("ms") if text.endswith("ms") else text.removesuffix("s")
    try:
        offset = float(number) * (1_000 if text.endswith("ms") else 1_000_000)
        return starts.select(*KEY, (F.col("_lo") + int(offset)).alias("us"))
    except ValueError:
        return starts.select(*KEY, F.unix_micros(F.try_to_timestamp(F.lit(token.strip()))).alias("us"))


def time_window(rows: DataFrame, selector: Selector) -> DataFrame:
    """The events that overlap the window from start to end, ends in the wrong order swapped; a missing end is the recording's."""
    spans = rows.groupBy(*KEY).agg(F.min("start_us").alias("_first"), F.max("end_us").alias("_last"))
    for name, token in (("_from", selector.get("start")), ("_to", selector.get("end"))):
        found = time_token(rows, token)
        spans = spans.withColumn(name, F.lit(None).cast("long")) if found is None else spans.join(found.withColumnRenamed("us", name), KEY, "left")
    low, high = F.coalesce("_from", "_first"), F.coalesce("_to", "_last")
    windows = spans.select(*KEY, F.least(low, high).alias("_lo"), F.greatest(low, high).alias("_hi"))
    return rows.join(windows, KEY).where((F.col("start_us") <= F.col("_hi")) & (F.col("end_us") >= F.col("_lo"))).drop("_lo", "_hi")


def incident(rows: DataFrame, name: str) -> DataFrame:
    """The incident window whose id or focus holds the name, with its events by family."""
    windows = jfr.incident_windows(rows).where(compact(F.col("window_id")).contains("".join(c for c in name.lower() if c.isalnum())) | (F.col("focus") == name.lower()))
    return jfr.window_events(rows, windows).groupBy(*KEY, "window_id", "signal_family").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.sum("size_bytes").alias("bytes"))


def overlapping_windows(rows: DataFrame, low_us: Column, high_us: Column) -> DataFrame:
    """Incident windows that meet a span, four a recording at most, by rank."""
    return jfr.incident_windows(rows).where((F.col("start_us") <= high_us) & (F.col("end_us") >= low_us)).where(F.col("rank") <= jfr.MOST_WINDOWS)


def type_detail(events: DataFrame, event_type: str) -> DataFrame:
    """Which fields the events of one exact type hold, how often, and up to four samples by start: artifact_id, field, present, share, samples."""
    rows = events.where(F.lower("type") == event_type.lower())
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy("startTime", F.xxhash64(*rows.columns))))
    fields = [c for c in events.columns if c not in ("artifact_id", "type", "stack")]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), (F.col("_r") <= SAMPLES).alias("shown")) for c in fields))).alias("f")
    values = F.collect_list(F.when(F.col("f.shown"), F.col("f.value")))  # four values a field at most
    sums = first.select(*KEY, "_r", cells).groupBy(*KEY, "f.field").agg(F.count("f.value").alias("present"), F.count("*").alias("_n"), F.array_sort(values).alias("samples"))
    return sums.where("present > 0").select(*KEY, "field", "present", ratio(F.col("present"), F.col("_n")).alias("share"), "samples")
