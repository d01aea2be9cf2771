"""Flight recordings as JSON lines (one event a line: type and values, as the JDK's own tool prints them) to a timeline.

The binary format has no reader that works without a JVM tool, so recordings are exported first; one event a line keeps files splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heapstone.functions.scalars import package
from heapstone.operators.ranking import ratio, top_per_group
from heapstone.operators.timeline import interval_clusters, representatives

#: Families of event types, the first of which a part of the lower-case type tells. Other types are generic.
FAMILIES = (
    ("lockContention", ("javamonitorblocked", "monitorenter")),
    ("monitorWait", ("javamonitorwait", "monitorwait")),
    ("gcPause", ("garbagecollection", "gcphasepause")),
    ("classLoading", ("classload", "classdefine", "classunload")),
    ("cpuLoad", ("cpuload",)),
    ("threadPark", ("threadpark",)),
    ("ioLatency", ("socketread", "socketwrite", "fileread", "filewrite")),
    ("exceptionBurst", ("exception", "errorthrown")),
    ("safepointPause", ("safepoint", "vmoperation")),
    ("allocation", ("objectallocation", "objectcountaftergc")),
    ("oldObject", ("oldobjectsample",)),
    ("executionSample", ("executionsample",)),
)
#: What summaries call the families.
SHORT = {"lockContention": "lock", "monitorWait": "monitor_wait", "gcPause": "gc", "classLoading": "class_loading", "cpuLoad": "cpu_load", "threadPark": "thread_park", "ioLatency": "io", "exceptionBurst": "exception", "safepointPause": "safepoint", "allocation": "allocation", "oldObject": "old_object", "executionSample": "execution"}
#: Weights of families in an event's importance, and of those not named.
WEIGHTS = {"gcPause": 3.0, "lockContention": 2.6, "monitorWait": 2.3, "threadPark": 2.0, "ioLatency": 2.0, "safepointPause": 2.0, "cpuLoad": 1.8, "classLoading": 2.2, "allocation": 2.2, "oldObject": 2.4, "exceptionBurst": 1.5, "executionSample": 1.0}
OTHER_WEIGHT = 0.5
#: Families whose stacks are runtime hotspots; types that are code cache events.
RUNTIME = ("lockContention", "monitorWait", "threadPark", "ioLatency", "exceptionBurst", "safepointPause")
CODE_CACHE = r"codecache|compilation|compilerphase"

_FRAME = T.StructType([T.StructField("method", T.StringType()), T.StructField("java", T.BooleanType())])
SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("startTime", T.StringType()), T.StructField("durationMs", T.LongType()), T.StructField("thread", T.StringType()), T.StructField("className", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("allocator", T.StringType()),
    T.StructField("rootType", T.StringType()), T.StructField("rootSystem", T.StringType()), T.StructField("rootDescription", T.StringType()), T.StructField("referenceDepth", T.LongType()), T.StructField("objectAgeMs", T.LongType()), T.StructField("machineTotal", T.DoubleType()), T.StructField("jvmTotal", T.DoubleType()), T.StructField("stack", T.ArrayType(_FRAME)),
])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*SCHEMA.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path).select(F.col("_metadata.file_path").alias("artifact_id"), "*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """artifact_id and the fields of SCHEMA; lines that are no event are in ``failures``."""
    return _raw(spark, path).where("type IS NOT NULL").drop("_bad")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """artifact_id, events, unreadable, status (PARSED, PARTIAL, FAILED) of every recording: a file that can't be read is a row, not an exception."""
    counts = _raw(spark, path).groupBy("artifact_id").agg(F.count_if(F.col("type").isNotNull()).alias("events"), F.count_if(F.col("type").isNull()).alias("unreadable"))
    return counts.withColumn("status", F.when(F.col("unreadable") == 0, "PARSED").when(F.col("events") > 0, "PARTIAL").otherwise("FAILED"))


def family(event_type: Column) -> Column:
    low, out = F.lower(event_type), F.lit("generic")
    for name, parts in reversed(FAMILIES):
        out = F.when(low.rlike("|".join(parts)), F.lit(name)).otherwise(out)
    return out


def cpu_ratio(value: Column) -> Column:
    """A load over 1 and up to 100 is a percentage; a negative one or none that is a number is null; others stay."""
    return F.when((value > 1) & (value <= 100), value / 100).when((value >= 0) & (value < float("inf")), value)


def timeline(events: DataFrame) -> DataFrame:
    """artifact_id, event_type, signal_family, start_us, end_us, duration_ms, top_method, top_stack (five of at most eight Java frames), and the event's own fields."""
    start = F.unix_micros(F.to_timestamp("startTime"))
    duration = F.coalesce("durationMs", F.lit(0))
    # Samples without a method, and generic events that tell nothing, are no part of the timeline.
    nothing = (F.col("signal_family") == "generic") & (F.col("duration_ms") == 0) & F.col("top_method").isNull() & F.col("thread").isNull() & F.col("class_name").isNull() & (F.col("size_bytes") == 0)
    silent = nothing | ((F.col("signal_family") == "executionSample") & F.col("top_method").isNull())
    frames = F.slice(F.transform(F.filter("stack", lambda f: F.coalesce(f["java"], F.lit(True))), lambda f: f["method"]), 1, 8)
    return events.select(
        "artifact_id", F.col("type").alias("event_type"), family(F.col("type")).alias("signal_family"), start.alias("start_us"), (start + duration * 1000).alias("end_us"), duration.alias("duration_ms"), F.when(F.size(frames) > 0, frames[0]).alias("top_method"), F.when(F.size(frames) > 0, F.array_join(F.slice(frames, 1, 5), " <- ")).alias("top_stack"),
        F.col("thread"), F.col("className").alias("class_name"), F.coalesce("bytes", F.lit(0)).alias("size_bytes"), "allocator", F.col("rootType").alias("root_type"), F.col("rootSystem").alias("root_system"), F.col("rootDescription").alias("root_description"), F.coalesce("referenceDepth", F.lit(0)).alias("reference_depth"), F.coalesce("objectAgeMs", F.lit(0)).alias("object_age_ms"),
        cpu_ratio(F.col("machineTotal")).alias("machine_total"), cpu_ratio(F.col("jvmTotal")).alias("jvm_total"),
    ).where("start_us IS NOT NULL").where(~silent)


def importance_score() -> Column:
    """1 and capped measures of duration, bytes and depth, the family's weight, a little for a known method and thread."""
    weight = F.lit(OTHER_WEIGHT)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("signal_family") == name, F.lit(w)).otherwise(weight)
    size = F.when(F.col("size_bytes") > 0, F.least(F.lit(12.0), F.col("size_bytes") / 1_000_000.0)).otherwise(F.lit(0.0))
    depth = F.when(F.col("reference_depth") > 0, F.least(F.lit(6.0), F.col("reference_depth") / 2.0)).otherwise(F.lit(0.0))
    named = F.when(F.col("top_method").isNotNull(), 0.35).otherwise(0.0) + F.when(F.col("thread").isNotNull(), 0.15).otherwise(0.0)
    return F.lit(1.0) + F.least(F.lit(12.0), F.col("duration_ms") / 50.0) + size + depth + weight + named


def importance(rows: DataFrame) -> DataFrame:
    """Adds ``importance``."""
    return rows.withColumn("importance", importance_score())


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("artifact_id", "event_type").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.avg("duration_ms").alias("average_ms"))


def by_family(rows: DataFrame) -> DataFrame:
    """artifact_id, signal_family, n, total_ms, max_ms, share of events and of time."""
    sums = rows.groupBy("artifact_id", "signal_family").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.sum("size_bytes").alias("bytes"))
    totals = sums.groupBy("artifact_id").agg(F.sum("n").alias("_n"), F.sum("total_ms").alias("_ms"))
    return sums.join(totals, "artifact_id").select("artifact_id", "signal_family", "n", "total_ms", "max_ms", "bytes", ratio(F.col("n"), F.col("_n")).alias("share"), ratio(F.col("total_ms"), F.col("_ms")).alias("duration_share"))


def hotspots(rows: DataFrame, families: list[str]) -> DataFrame:
    """artifact_id, top_method, n, share, bytes, byte_share of the methods on top of a family's stacks."""
    tops = rows.where(F.col("signal_family").isin(families) & F.col("top_method").isNotNull()).groupBy("artifact_id", "top_method").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    totals = tops.groupBy("artifact_id").agg(F.sum("n").alias("_n"), F.sum("bytes").alias("_b"))
    return tops.join(totals, "artifact_id").select("artifact_id", "top_method", "n", ratio(F.col("n"), F.col("_n")).alias("share"), "bytes", ratio(F.col("bytes"), F.col("_b")).alias("byte_share"))


def classes(rows: DataFrame, families: list[str]) -> DataFrame:
    """artifact_id, class_name, package, n, share, bytes, byte_share."""
    tops = rows.where(F.col("signal_family").isin(families) & (F.coalesce("class_name", F.lit("")) != "")).groupBy("artifact_id", "class_name").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    totals = tops.groupBy("artifact_id").agg(F.sum("n").alias("_n"), F.sum("bytes").alias("_b"))
    return tops.join(totals, "artifact_id").select("artifact_id", "class_name", package(F.col("class_name")).alias("package"), "n", ratio(F.col("n"), F.col("_n")).alias("share"), "bytes", ratio(F.col("bytes"), F.col("_b")).alias("byte_share"))


INCIDENT_GAP_US, MOST_WINDOWS, WINDOW_EVENTS, HIGHLIGHTS = 250_000, 4, 6, 18
#: What an incident may focus on, in order of priority: the window's id, the families; the last only where no other is found.
FOCUSES = (
    ("runtime", "runtime-pressure", ("gcPause", "lockContention", "monitorWait", "threadPark", "cpuLoad", "ioLatency", "exceptionBurst", "safepointPause")),
    ("class-loading", "class-loading-pressure", ("classLoading",)),
    ("allocation", "allocation-pressure", ("allocation",)),
    ("retention", "retained-object-pressure", ("oldObject",)),
    ("activity", "recording-activity", tuple(name for name, _ in FAMILIES)),
)


def focus_score(focus: Column) -> Column:
    """An event's importance to a focus: bytes count again for memory, depth for retention, duration for the runtime."""
    size = F.least(F.lit(12.0), F.col("size_bytes") / 1_000_000.0)
    more = F.when(focus.isin("class-loading", "allocation"), size).when(focus == "retention", size + F.least(F.lit(6.0), F.col("reference_depth") / 2.0)).when((focus == "runtime") & (F.col("duration_ms") > 0), F.least(F.lit(10.0), F.col("duration_ms") / 40.0)).otherwise(F.lit(0.0))
    return importance_score() + more


def _micro(score: Column) -> Column:
    """A score in millionths, so that sums don't depend on their order."""
    return F.round(score * 1_000_000).cast("long")


def incident_windows(rows: DataFrame) -> DataFrame:
    """artifact_id, window_id, focus, start_us, end_us, n, score_micro, place: for each focus its best cluster of events, at most four windows a recording.

    A focus's events cluster within 250 ms; the cluster with the highest focus score (ties: the earliest) is the window. All events that overlap it,
    250 ms to each side, belong to it, and their importance sums to its score. Windows of one start, end and size show once, under the first focus.
    """
    key = "artifact_id"
    placed = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(focus).alias("focus"), F.lit(name).alias("window_id")) for k, (focus, name, _) in enumerate(FOCUSES)))
    fits = F.array(*(F.col("signal_family").isin(*families) for _, _, families in FOCUSES))
    mine = rows.select("*", F.explode(F.filter(placed, lambda x: F.element_at(fits, x["place"] + 1))).alias("f")).select(key, "event_type", "start_us", "end_us", "f.*", _micro(focus_score(F.col("f.focus"))).alias("s"))
    clusters = interval_clusters(mine, [key, "focus"], "start_us", "end_us", INCIDENT_GAP_US, "event_type")
    sums = clusters.groupBy(key, "place", "focus", "window_id", "cluster").agg(F.sum("s").alias("s"), F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    best = sums.groupBy(key, "place", "focus", "window_id").agg(F.max(F.struct(F.col("s"), (-F.col("cluster")).alias("c"), F.col("lo"), F.col("hi"))).alias("b")).select(key, "place", "focus", "window_id", "b.lo", "b.hi")
    others = Window.partitionBy(key)
    wanted = best.withColumn("_real", F.max(F.col("place") < 4).over(others)).where("place < 4 OR NOT _real").drop("_real")
    inside = rows.join(wanted, key).where((F.col("start_us") <= F.col("hi") + INCIDENT_GAP_US) & (F.col("end_us") >= F.col("lo") - INCIDENT_GAP_US))
    windows = inside.groupBy(key, "place", "focus", "window_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"), F.sum(_micro(importance_score())).alias("score_micro"))
    once = windows.groupBy(key, "start_us", "end_us", "n").agg(F.min(F.struct("place", "focus", "window_id", "score_micro")).alias("w")).select(key, "w.*", "start_us", "end_us", "n")
    order = Window.partitionBy(key).orderBy(F.desc("score_micro"), "place", "start_us", "window_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_WINDOWS).select(key, "window_id", "focus", "start_us", "end_us", "n", "score_micro", "rank")


def window_events(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window's events: those that overlap it with 250 ms to each side; at most four windows a recording join here."""
    spans = windows.select("artifact_id", "window_id", "rank", F.col("start_us").alias("_lo"), F.col("end_us").alias("_hi"))
    return rows.join(spans, "artifact_id").where((F.col("start_us") <= F.col("_hi") + INCIDENT_GAP_US) & (F.col("end_us") >= F.col("_lo") - INCIDENT_GAP_US)).drop("_lo", "_hi")


def chronology_highlights(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The first, last and most important events of each window, six at most, each once, 18 a recording, by start: with ``position`` from 1.

    Recordings without a window show their own first, last and most important ones.
    """
    scored = importance(rows).withColumn("importance", F.round("importance", 6))
    identity = ["artifact_id", "start_us", "event_type", "thread", "top_method", "duration_ms", "size_bytes"]
    picked = representatives(window_events(scored, windows), ["artifact_id", "window_id"], ["start_us", "event_type"], "importance", WINDOW_EVENTS)
    alone = representatives(scored.join(windows.select("artifact_id").distinct(), "artifact_id", "left_anti"), ["artifact_id"], ["start_us", "event_type"], "importance", HIGHLIGHTS)
    every = picked.select(*identity, "signal_family", "importance").unionByName(alone.select(*identity, "signal_family", "importance")).distinct()
    return top_per_group(every, ["artifact_id"], [F.col("start_us"), F.col("event_type"), F.desc("importance"), F.col("thread"), F.col("top_method")], HIGHLIGHTS)


def summary(rows: DataFrame) -> DataFrame:
    """One row for each recording with what the rules read: counts, totals and maxima by family, top methods, classes and shares, CPU loads, object ages and depths."""
    key, fam = "artifact_id", F.col("signal_family")
    aggs = []
    def measures(c: str, mine: Column) -> list[Column]:
        total = lambda f, v: F.coalesce(f(F.when(mine, F.col(v))), F.lit(0))
        return [F.count_if(mine).alias(f"{c}_count"), total(F.sum, "duration_ms").alias(f"{c}_total_ms"), total(F.max, "duration_ms").alias(f"{c}_max_ms"), total(F.sum, "size_bytes").alias(f"{c}_bytes"), total(F.max, "size_bytes").alias(f"{c}_max_bytes")]

    low = F.lower("event_type")
    for name, _ in FAMILIES:
        aggs += measures(SHORT[name], fam == name)
    aggs += measures("code_cache", low.rlike(CODE_CACHE))
    old, loads = fam == "oldObject", (fam == "cpuLoad") & ~low.contains("threadcpuload")
    aggs += [
        F.count_if(low.contains("virtualthreadpinned")).alias("pinned_count"), F.coalesce(F.max(F.when(low.contains("virtualthreadpinned"), F.col("duration_ms"))), F.lit(0)).alias("virtual_thread_max_ms"), F.count_if(low.contains("submitfailed")).alias("submit_failed_count"), F.coalesce(F.max(F.when(old, F.col("object_age_ms"))), F.lit(0)).alias("max_object_age_ms"), F.coalesce(F.max(F.when(old, F.col("reference_depth"))), F.lit(0)).alias("max_reference_depth"),
        F.coalesce(F.avg(F.when(old & (F.col("reference_depth") > 0), F.col("reference_depth"))), F.lit(0.0)).alias("average_reference_depth"), F.count_if(old & (F.col("reference_depth") > 0)).alias("depth_count"), F.coalesce(F.max(F.when(loads, F.col("machine_total"))), F.lit(0.0)).alias("peak_machine_total"), F.coalesce(F.avg(F.when(loads, F.col("machine_total"))), F.lit(0.0)).alias("average_machine_total"), F.coalesce(F.max(F.when(loads, F.col("jvm_total"))), F.lit(0.0)).alias("peak_jvm_total"),
        F.count_if(low.contains("codecachefull")).alias("code_cache_full_count"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
    ]
    out = rows.groupBy(key).agg(*aggs)
    best = lambda df, name, p: df.groupBy(key).agg(F.min_by(F.struct("n", "share", "byte_share", name), F.struct(-F.col("n"), -F.col("share"), -F.col("byte_share"), F.col(name))).alias("b")).select(key, F.col(f"b.{name}").alias(f"{p}"), F.col("b.n").alias(f"{p}_count"), F.col("b.share").alias(f"{p}_share"), F.col("b.byte_share").alias(f"{p}_byte_share"))
    for df, name, p in ((hotspots(rows, ["executionSample"]), "top_method", "execution_method"), (hotspots(rows, list(RUNTIME)), "top_method", "runtime_method"), (hotspots(rows, ["allocation"]), "top_method", "allocation_method"), (classes(rows, ["allocation"]), "class_name", "allocation_class"), (classes(rows, ["oldObject"]), "class_name", "old_object_class")):
        out = out.join(best(df, name, p), key, "left")
    return out.fillna(0)
