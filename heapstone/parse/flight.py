"""What binary recordings hold, as tables: events for the timeline, declared types, depths of references, and the JVM they are of.

The parts come from ``heapstone.sources.recordings``; all that is said here about them is column expressions, joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.grouped import in_groups
from heapstone.parse.jfr import family
from heapstone.sources.recordings import elements_of
from heapstone.sources.stored import stored

KEY = "artifact_id"
#: The fields that may say what class an event is about, how many bytes, and the like; the first that does is taken.
CLASS = {
    "allocation": ("objectClass", "objectClassName", "allocationClass", "allocatedClass", "className", "class", "type"),
    "classLoading": ("definedClass", "loadedClass", "objectClass", "className", "definedClassName", "loadedClassName", "class", "type"),
    "oldObject": ("objectClass", "objectType", "className", "class", "type", "object.type"),
}
BYTES = {
    "allocation": ("allocationSize", "weight", "objectSize", "bytesAllocated", "bytes", "size"),
    "classLoading": ("metadataBytes", "classBytes", "bytes", "weight", "size"),
    "oldObject": ("objectSize", "sampledObjectSize", "retainedSize", "totalSize", "size"),
}
ALLOCATOR = ("allocator", "allocationContext", "allocationSource", "allocationPathLabel", "context")
DEPTH = ("referenceDepth", "referrerDepth", "pathDepth", "depth")
AGE_NS, AGE_MS = ("objectAge", "age"), ("objectAgeMs", "ageMs")
MACHINE = ("machineTotal", "machineCpuLoad", "machineLoad")
JVM = ("jvmTotal", "processTotal", "processCpuLoad")
JVM_USER, JVM_SYSTEM = ("jvmUser", "processUser", "userCpuLoad"), ("jvmSystem", "processSystem", "systemCpuLoad")
#: Fields of any event that never say such things.
IGNORED = ("starttime", "endtime", "duration", "eventthread", "thread", "sampledthread", "stacktrace")
#: Steps of a walk from an object to what holds it, and the doublings that make as many.
MOST_STEPS, DOUBLINGS = 64, 6
#: Events that tell a setting of the JVM: type, what it is a setting of, fields of its name and value.
SETTINGS = (
    ("jdk.InitialSystemProperty", "property", "key", "value"), ("jdk.InitialEnvironmentVariable", "environment", "key", "value"), ("jdk.BooleanFlag", "flag", "name", "value"), ("jdk.IntFlag", "flag", "name", "value"), ("jdk.UnsignedIntFlag", "flag", "name", "value"),
    ("jdk.LongFlag", "flag", "name", "value"), ("jdk.UnsignedLongFlag", "flag", "name", "value"), ("jdk.DoubleFlag", "flag", "name", "value"), ("jdk.StringFlag", "flag", "name", "value"),
)
#: Fields of the event about the JVM itself.
ABOUT = ("jvmName", "jvmVersion", "jvmArguments", "jvmFlags", "javaArguments", "pid")

_NUMBER = r"^-?\d+(\.\d+)?(E-?\d+)?$"


def _field(name: str) -> Column:
    return F.col("fields")[name]


def _first(names: tuple[str, ...], use: Callable[[Column], Column]) -> Column:
    return F.coalesce(*(use(_field(n)) for n in names))


def _text(value: Column) -> Column:
    return F.when(~value.rlike(_NUMBER) & (F.trim(value) != ""), F.trim(value))


def _positive(value: Column) -> Column:
    number = value.try_cast("long")
    return F.when(number > 0, number)


def _natural(value: Column) -> Column:
    number = value.try_cast("long")
    return F.when(number >= 0, number)


def _div(value: Column, by: int) -> Column:
    """Whole division; nanoseconds are too large for doubles."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def _load(value: Column) -> Column:
    return value.try_cast("double")


def _like(fits: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """The first field whose name fits and whose value is of use, in the order they are declared."""
    own = lambda e: ~F.contains(e["key"], F.lit(".")) & ~F.lower(e["key"]).isin(*IGNORED) & fits(F.lower(e["key"])) & use(e["value"]).isNotNull()
    return use(F.get(F.filter(F.map_entries("fields"), own), F.lit(0))["value"])


def _class(kind: str) -> Column:
    found = _first(CLASS[kind], _text)
    if kind == "allocation":
        return F.coalesce(found, _like(lambda n: F.contains(n, F.lit("class")) | F.contains(n, F.lit("type")), _text))
    return F.coalesce(found, _like(lambda n: F.contains(n, F.lit("class")), _text)) if kind == "classLoading" else found


def _bytes(kind: str) -> Column:
    found = _first(BYTES[kind], _positive)
    if kind == "allocation":
        return F.coalesce(found, _like(lambda n: (n != "tlabsize") & (F.contains(n, F.lit("allocation")) | n.endswith("size") | n.endswith("bytes")), _positive))
    return F.coalesce(found, _like(lambda n: F.contains(n, F.lit("byte")) | n.endswith("size") | F.contains(n, F.lit("weight")), _positive)) if kind == "classLoading" else found


def _of_family(kind: Column, value: Callable[[str], Column]) -> Column:
    out = F.lit(None)
    for name in CLASS:
        out = F.when(kind == name, value(name)).otherwise(out)
    return out


def events(rows: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """artifact_id and the fields that ``jfr.timeline`` reads, from the part ``events``: as the reader of JSON lines gives them.

    ``depths`` (``reference_depths``) fills in the depth of old objects whose events hold none. A chunk has few old objects, so the join is small.
    """
    kind = family(F.col("type"))
    old = kind == "oldObject"
    depth = F.when(old, _first(DEPTH, _natural))
    if depths is not None:
        of = depths.select(KEY, "chunk_at", F.col("key").cast("string").alias("_key"), F.col("depth").alias("_depth"))
        rows = rows.withColumn("_key", F.when(old, _field("object"))).join(of, [KEY, "chunk_at", "_key"], "left")
        depth = F.coalesce(depth, F.when(old, F.col("_depth")))
    age = F.coalesce(_div(_first(AGE_NS, _natural), 1_000_000), _first(AGE_MS, _natural))
    user, system = _first(JVM_USER, _load), _first(JVM_SYSTEM, _load)
    both = F.when(user.isNotNull() | system.isNotNull(), F.least(F.lit(1.0), F.coalesce(user, F.lit(0.0)) + F.coalesce(system, F.lit(0.0))))
    start = F.date_format(F.timestamp_micros(_div(F.col("start_ns"), 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    part = lambda *names: F.when(old, _first(names, _text))
    return rows.select(
        KEY, "type", start.alias("startTime"), F.greatest(_div(F.col("duration_ns"), 1_000_000), F.lit(0)).alias("durationMs"), "thread", _of_family(kind, _class).alias("className"), _of_family(kind, _bytes).cast("long").alias("bytes"),
        F.when(kind == "allocation", F.coalesce(_first(ALLOCATOR, _text), _like(lambda n: F.contains(n, F.lit("allocator")) | F.contains(n, F.lit("context")) | F.contains(n, F.lit("source")), _text))).alias("allocator"), part("rootType", "root.type").alias("rootType"), part("rootSystem", "root.system").alias("rootSystem"), part("rootDescription", "root.description").alias("rootDescription"),
        depth.alias("referenceDepth"), F.when(old, age).cast("long").alias("objectAgeMs"), F.when(kind == "cpuLoad", _first(MACHINE, _load)).alias("machineTotal"), F.when(kind == "cpuLoad", F.coalesce(_first(JVM, _load), both)).alias("jvmTotal"), "stack",
    )


def declared_types(elements: DataFrame) -> DataFrame:
    """artifact_id, name, label, description, categories, field_count, fields (name, label, description, type) of every type of event, whether it has events or not.

    Chunks of a recording declare their types again; each type is as the first chunk that has it says. Fields stand as they are declared.
    """
    chunk = [KEY, "chunk_at"]
    own = lambda name: F.col("attributes")[name]
    classes = elements.where("element = 'class'").select(*chunk, "position", own("id").alias("id"), own("name").alias("name"), own("superType").alias("above"))
    names = classes.select(*chunk, F.col("id").alias("class"), F.col("name").alias("kind"))
    first = Window.partitionBy(KEY, "name").orderBy("chunk_at")
    types = classes.where("above = 'jdk.jfr.Event'").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*chunk, F.col("position").alias("of"), "name")
    numbered = F.filter(F.map_entries("attributes"), lambda e: e["key"].startswith("value-"))
    values = F.transform(F.array_sort(F.transform(numbered, lambda e: F.struct(F.substring_index(e["key"], "-", -1).try_cast("int").alias("n"), e["value"].alias("v")))), lambda x: x["v"])
    notes = elements.where("element = 'annotation'").select(*chunk, F.col("parent").alias("of"), own("class").alias("class"), own("value").alias("value"), values.alias("values")).join(names, [*chunk, "class"])
    note = lambda name: F.max(F.when(F.col("kind") == name, F.col("value")))
    noted = notes.groupBy(*chunk, "of").agg(note("jdk.jfr.Label").alias("label"), note("jdk.jfr.Description").alias("description"), F.max(F.when(F.col("kind") == "jdk.jfr.Category", F.when(F.size("values") > 0, F.col("values")).otherwise(F.array("value")))).alias("categories"))
    declared = elements.where("element = 'field'").select(*chunk, "position", F.col("parent").alias("of"), own("name").alias("field"), own("class").alias("class")).join(names, [*chunk, "class"])
    said = declared.join(noted.withColumnRenamed("of", "position").drop("categories"), [*chunk, "position"], "left")
    fields = said.groupBy(*chunk, "of").agg(F.array_sort(F.collect_list(F.struct("position", F.col("field").alias("name"), "label", "description", F.col("kind").alias("type")))).alias("fields"))
    listed = F.transform(F.coalesce("fields", F.array()), lambda f: F.struct(f["name"].alias("name"), f["label"].alias("label"), f["description"].alias("description"), f["type"].alias("type")))
    return types.join(noted, [*chunk, "of"], "left").join(fields, [*chunk, "of"], "left").select(KEY, "name", "label", "description", "categories", F.size(listed).alias("field_count"), listed.alias("fields"))


def types_of_declarations(declarations: DataFrame) -> DataFrame:
    """What ``declared_types`` gives, from the part ``declarations``: equal declarations, which the chunks of a JVM share, are opened once."""
    told = stored(declarations, "declarations")
    whole = told.where("declared IS NOT NULL").groupBy("digest").agg(F.first("declared").alias("declared"))
    opened = declared_types(elements_of(whole.select(F.col("digest").alias(KEY), F.lit(0).alias("chunk_at"), "declared"))).withColumnRenamed(KEY, "digest")
    shown = [c for c in opened.columns if c not in ("digest", "name")]
    by_digest = opened.groupBy("digest").agg(F.collect_list(F.struct("name", *shown)).alias("types"))
    each = told.groupBy(KEY, "digest").agg(F.min("chunk_at").alias("chunk_at")).join(F.broadcast(by_digest), "digest").select(KEY, "chunk_at", F.explode("types").alias("t"))
    first = each.groupBy(KEY, F.col("t.name").alias("name")).agg(F.min_by("t", "chunk_at").alias("t"))
    return first.select(KEY, "name", *(F.col(f"t.{c}").alias(c) for c in shown))


def types_without_events(types: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared types that no event of their recording is of."""
    return types.join(rows.select(KEY, F.col("type").alias("name")).distinct(), [KEY, "name"], "left_anti")


#: The types of constants that tell what holds an object.
HELD = ("jdk.types.Reference", "jdk.types.OldObject")


def reference_depths(constants: DataFrame) -> DataFrame:
    """artifact_id, chunk_at, key, depth: how far each old object is from what holds it, from the part ``constants`` (the types in ``HELD``).

    Each reference is one step and those it skips; a walk ends where nothing refers to an object, or after MOST_STEPS references. Pointers
    jump: after k doublings each object knows the cost of 2**k steps and where they lead, so six make all walks of a chunk at once, cycles too.
    References don't leave their chunk, so a chunk's objects are one group and its rows are shuffled once.
    """
    number = lambda name: F.col("fields")[name].try_cast("long")
    is_link = F.col("type") == HELD[0]
    cost = F.lit(1) + F.greatest(F.coalesce(number("skip"), F.lit(0)), F.lit(0))
    rows = constants.where(F.col("type").isin(*HELD)).select(KEY, "chunk_at", "key", is_link.alias("link"), F.when(is_link, number("object")).otherwise(number("referrer")).alias("to"), F.when(is_link, cost).alias("cost"))
    return in_groups(rows, [KEY, "chunk_at"], [], _walks, f"{KEY} string, chunk_at long, key long, depth long")


def _walks(rows: pa.Table) -> pa.Table:
    columns = [rows[c].to_pylist() for c in ("key", "link", "to", "cost")]
    links = {key: (to, cost) for key, link, to, cost in zip(*columns, strict=True) if link}
    nodes = {key: to for key, link, to, _ in zip(*columns, strict=True) if not link}
    steps = [links.get(by, (None, 0)) for by in nodes.values()]
    place = {key: i for i, key in enumerate(nodes)}
    where = np.array([*(place.get(to, len(nodes)) for to, _ in steps), len(nodes)])  # the last place is where walks end
    depth = np.array([*(cost for _, cost in steps), 0], np.int64)
    for _ in range(DOUBLINGS):
        depth, where = depth + depth[where], where[where]
    n = len(nodes)
    return pa.table({KEY: pa.array([rows[KEY][0].as_py()] * n, pa.string()), "chunk_at": pa.array([rows["chunk_at"][0].as_py()] * n, pa.int64()), "key": pa.array(list(nodes), pa.int64()), "depth": depth[:-1]})


def _told() -> Column:
    """The settings that an event tells: an array of kind, name, value."""
    told = F.array(*(F.when(F.col("type") == t, F.struct(F.lit(kind).alias("kind"), _field(name).alias("name"), _field(value).alias("value"))) for t, kind, name, value in SETTINGS))
    about = F.when(F.col("type") == "jdk.JVMInformation", F.array(*(F.struct(F.lit("jvm").alias("kind"), F.lit(n).alias("name"), _field(n).alias("value")) for n in ABOUT)))
    return F.filter(F.coalesce(about, told), lambda s: s["name"].isNotNull() & s["value"].isNotNull())


def settings(rows: DataFrame) -> DataFrame:
    """artifact_id, kind, name, value: system properties, variables, flags and what the JVM says of itself, each as it was told last."""
    mine = rows.where(F.col("type").isin("jdk.JVMInformation", *(t for t, *_ in SETTINGS))).select(KEY, "start_ns", "chunk_at", "at", F.explode(_told()).alias("s"))
    last = F.max_by("s.value", F.struct("start_ns", "chunk_at", "at"))
    return mine.groupBy(KEY, F.col("s.kind").alias("kind"), F.col("s.name").alias("name")).agg(last.alias("value"))


def runtime_info(rows: DataFrame) -> DataFrame:
    """artifact_id, jvm_start_ms, recording_start_ms, start_offset_ms, settings: one row a recording.

    The JVM's start is the earliest that is told; the offset is null where none is, or where the recording began before it. ``settings`` maps
    ``kind:name`` to the last value; a JVM has some hundreds of them.
    """
    jvm = F.when(F.col("type") == "jdk.JVMInformation", F.when(_field("jvmStartTime").try_cast("long") > 0, _div(_field("jvmStartTime").try_cast("long"), 1_000_000)))
    # one pass over the events: each row's settings, or one row without any, first by name and then by recording
    each = rows.select(KEY, "start_ns", "chunk_at", "at", jvm.alias("jvm"), F.explode_outer(_told()).alias("s"))
    last = F.max_by("s.value", F.struct("start_ns", "chunk_at", "at"))
    named = each.groupBy(KEY, F.concat_ws(":", "s.kind", "s.name").alias("key")).agg(F.min("jvm").alias("jvm"), F.min("start_ns").alias("first"), last.alias("value"))
    told = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value")))
    times = named.groupBy(KEY).agg(F.min("jvm").alias("jvm_start_ms"), _div(F.min("first"), 1_000_000).alias("recording_start_ms"), F.map_from_entries(F.array_sort(told)).alias("settings"))
    offset = F.when(F.col("recording_start_ms") >= F.col("jvm_start_ms"), F.col("recording_start_ms") - F.col("jvm_start_ms"))
    return times.select(KEY, "jvm_start_ms", "recording_start_ms", offset.alias("start_offset_ms"), "settings")


def recordings(chunks: DataFrame) -> DataFrame:
    """artifact_id, chunks, events, failed, status (PARSED, PARTIAL, FAILED), error (of the first chunk that failed): one row a recording, however it reads."""
    bad = F.col("error").isNotNull()
    sums = chunks.groupBy(KEY).agg(F.count("*").alias("chunks"), F.sum("events").alias("events"), F.count_if(bad).alias("failed"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("chunk_at"))).alias("error"))
    status = F.when(F.col("failed") == 0, "PARSED").when(F.col("failed") < F.col("chunks"), "PARTIAL").otherwise("FAILED")
    return sums.select(KEY, "chunks", "events", "failed", status.alias("status"), "error")
