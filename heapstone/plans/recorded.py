"""Queries over binary recordings, rendered from the table of events: each thread's events are a recording of several chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators.grouped import in_groups
from heapstone.parse import flight, jfr
from heapstone.plans.base import events, query
from heapstone.sources import flight_writer, recordings
from heapstone.sources.flight_writer import Declared
from heapstone.sources.stored import stored

_START = ("startTime", "long", False, False, {"jdk.jfr.Timestamp": {"value": "TICKS"}, "jdk.jfr.Label": {"value": "Start Time"}})
_DURATION = ("duration", "long", False, False, {"jdk.jfr.Timespan": {"value": "TICKS"}})
_THREAD = ("eventThread", "java.lang.Thread", True, False, {"jdk.jfr.Description": {"value": "Thread of the event"}})
_STACK = ("stackTrace", "jdk.types.StackTrace", True, False, {})


def _plain(name: str, kind: str, pooled: bool = False, many: bool = False) -> tuple:
    return name, kind, pooled, many, {}


def _event(name: str, label: str, category: str, *fields: tuple) -> Declared:
    return Declared(name, [_START, *fields], "jdk.jfr.Event", {"jdk.jfr.Label": {"value": label}, "jdk.jfr.Category": {"value-0": "Java", "value-1": category}})


TYPES = [
    _event("jdk.JavaMonitorEnter", "Java Monitor Blocked", "Locks", _DURATION, _THREAD, _STACK, _plain("monitorClass", "java.lang.Class", True)),
    _event("jdk.ObjectAllocationSample", "Object Allocation Sample", "Memory", _THREAD, _STACK, _plain("objectClass", "java.lang.Class", True), _plain("weight", "long")),
    _event("jdk.ExecutionSample", "Method Profiling Sample", "Profiling", _plain("sampledThread", "java.lang.Thread", True), _STACK),
    _event("jdk.GCPhasePause", "GC Phase Pause", "Memory", _DURATION, _THREAD, _STACK, _plain("gcId", "int"), _plain("name", "java.lang.String")),
    _event("jdk.OldObjectSample", "Old Object Sample", "Memory", _DURATION, _THREAD, _STACK, ("objectAge", "long", False, False, {"jdk.jfr.Timespan": {"value": "TICKS"}}), _plain("objectSize", "long"), _plain("object", "jdk.types.OldObject", True)),
    _event("jdk.ThreadPark", "Java Thread Park", "Locks", _DURATION, _THREAD),
    _event("jdk.CPULoad", "CPU Load", "Processor", _DURATION, _THREAD, _plain("jvmUser", "double"), _plain("jvmSystem", "double"), _plain("machineTotal", "double")),
    _event("jdk.JVMInformation", "JVM Information", "Runtime", _plain("jvmName", "java.lang.String"), ("jvmStartTime", "long", False, False, {"jdk.jfr.Timestamp": {"value": "MILLISECONDS_SINCE_EPOCH"}})),
    _event("jdk.InitialSystemProperty", "Initial System Property", "Runtime", _plain("key", "java.lang.String"), _plain("value", "java.lang.String")),
    _event("jdk.DataLoss", "Data Loss", "Runtime", _plain("amount", "long")),
    Declared("java.lang.Thread", [_plain("osName", "java.lang.String"), _plain("osThreadId", "long"), _plain("javaName", "java.lang.String")]),
    Declared("java.lang.Class", [_plain("name", "jdk.types.Symbol", True)]),
    Declared("jdk.types.Symbol", [_plain("string", "java.lang.String")]),
    Declared("jdk.types.Method", [_plain("type", "java.lang.Class", True), _plain("name", "jdk.types.Symbol", True)]),
    Declared("jdk.types.StackFrame", [_plain("method", "jdk.types.Method", True), _plain("lineNumber", "int")]),
    Declared("jdk.types.StackTrace", [_plain("truncated", "boolean"), _plain("frames", "jdk.types.StackFrame", many=True)]),
    Declared("jdk.types.Reference", [_plain("object", "jdk.types.OldObject", True), _plain("skip", "int")]),
    Declared("jdk.types.OldObject", [_plain("address", "long"), _plain("type", "java.lang.Class", True), _plain("referrer", "jdk.types.Reference", True)]),
]
#: Every chunk declares the same types.
_DECLARATIONS = flight_writer.Declarations(TYPES)


class _Names:
    """Keys of a chunk's pools by what they stand for."""

    def __init__(self, chunk: flight_writer.Chunk):
        self.chunk, self.keys = chunk, {}

    def _of(self, kind: str, what: object, **values: object) -> int:
        key = self.keys.get((kind, what))
        if key is None:
            key = self.keys[kind, what] = self.chunk.constant(kind, len(self.keys) + 1, **values)
        return key

    def symbol(self, name: str) -> int:
        return self._of("jdk.types.Symbol", name, string=name)

    def type(self, name: str) -> int:
        return self._of("java.lang.Class", name, name=self.symbol(name.replace(".", "/")))

    def thread(self, name: str) -> int:
        return self._of("java.lang.Thread", name, osName="os-" + name, osThreadId=1, javaName=name)

    def stack(self, *methods: tuple[str, str]) -> int:
        frames = [{"method": self._of("jdk.types.Method", m, type=self.type(m[0]), name=self.symbol(m[1])), "lineNumber": 7} for m in methods]
        return self._of("jdk.types.StackTrace", methods, truncated=False, frames=frames)

    def old_object(self, n: int, name: str, length: int) -> int:
        """A chain of ``length`` references, the first of which skips some."""
        for i in range(length + 1):
            if i < length:
                self.chunk.constant("jdk.types.Reference", n * 100 + i + 1, object=n * 100 + i + 1, skip=n % 3 if i == 0 else 0)
            self.chunk.constant("jdk.types.OldObject", n * 100 + i, address=i, type=self.type(name), referrer=n * 100 + i + 1 if i < length else 0)
        return n * 100


def render(rows: pa.Table) -> bytes:
    """One chunk of the events of one thread: n, c, ms and kind, in order of n."""
    rows = rows.sort_by("n").to_pylist()
    first = min(r["ms"] for r in rows) * 1_000_000
    chunk = flight_writer.Chunk(_DECLARATIONS, first)
    names = _Names(chunk)
    chunk.event("jdk.JVMInformation", startTime=first, jvmName="Server VM", jvmStartTime=first // 1_000_000 - 5000)
    for r in rows:
        n, c, kind = r["n"], r["c"], r["kind"]
        common = {"startTime": r["ms"] * 1_000_000, "duration": c // 10 * 1_000_000, "eventThread": names.thread(f"t{n % 4}"), "stackTrace": names.stack(("com.shop.Order", f"step{n % 3}"), ("com.shop.Main", "main"))}
        name = f"com.shop.C{n % 5}"
        if kind == "error":
            chunk.event("jdk.JavaMonitorEnter", **common, monitorClass=names.type(name))
        elif kind == "click":
            chunk.event("jdk.ObjectAllocationSample", **common, objectClass=names.type(name), weight=c * 100)
        elif kind == "view":
            chunk.event("jdk.ExecutionSample", **common, sampledThread=common["eventThread"])
        elif kind == "purchase" and n % 2 == 0:
            chunk.event("jdk.GCPhasePause", **common, gcId=n, name="GC Pause")
        elif kind == "purchase":
            chunk.event("jdk.OldObjectSample", **common, objectAge=c * 10_000_000, objectSize=c * 100, object=names.old_object(n, name, 70 if n % 50 == 1 else n % 7))
        elif n % 2 == 0:
            chunk.event("jdk.ThreadPark", **common)
            chunk.event("jdk.InitialSystemProperty", startTime=common["startTime"], key=f"k{n % 5}", value=f"v{n}")
        else:
            chunk.event("jdk.CPULoad", **common, jvmUser=(n % 90) / 100, jvmSystem=0.0, machineTotal=float(n % 150))
    return chunk.bytes()


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, chunk_at, content: two chunks for each thread and 65,536 ids of events."""
    n = F.col("event_id")
    rows = events(spark, sf_dir).select(F.concat(F.lit("j-"), F.col("user_id").cast("string")).alias("artifact_id"), (F.floor(n / 65536) * 2 + n % 2).alias("chunk_at"), n.alias("n"), F.col("cents").alias("c"), F.floor(F.col("us") / 1000).alias("ms"), F.col("event_type").alias("kind"))

    def write(table: pa.Table) -> pa.Table:
        return pa.table({"artifact_id": table["artifact_id"][:1], "chunk_at": table["chunk_at"][:1], "content": pa.array([render(table)], pa.binary())})

    return in_groups(rows, ["artifact_id", "chunk_at"], ["n"], write, "artifact_id string, chunk_at long, content binary")


_ROWS = """e AS (SELECT event_id AS n, round(value * 100)::BIGINT AS c, event_type, 'j-' || user_id AS artifact_id, epoch_us(ts) // 1000 AS ms, event_id // 65536 * 2 + event_id % 2 AS chunk FROM events)"""


@query(f"""WITH {_ROWS}, t AS (SELECT *, CASE event_type WHEN 'error' THEN 'jdk.JavaMonitorEnter' WHEN 'click' THEN 'jdk.ObjectAllocationSample' WHEN 'view' THEN 'jdk.ExecutionSample' WHEN 'purchase' THEN CASE WHEN n % 2 = 0 THEN 'jdk.GCPhasePause' ELSE 'jdk.OldObjectSample' END ELSE CASE WHEN n % 2 = 0 THEN 'jdk.ThreadPark' ELSE 'jdk.CPULoad' END END AS event_type2,
  CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE c // 10 END AS duration_ms, event_type = 'purchase' AND n % 2 = 1 AS old FROM e)
 SELECT artifact_id, event_type2 AS event_type, CASE event_type2 WHEN 'jdk.JavaMonitorEnter' THEN 'lockContention' WHEN 'jdk.ObjectAllocationSample' THEN 'allocation' WHEN 'jdk.ExecutionSample' THEN 'executionSample' WHEN 'jdk.GCPhasePause' THEN 'gcPause' WHEN 'jdk.OldObjectSample' THEN 'oldObject' WHEN 'jdk.ThreadPark' THEN 'threadPark' ELSE 'cpuLoad' END AS signal_family,
  ms * 1000 AS start_us, ms * 1000 + duration_ms * 1000 AS end_us, duration_ms, CASE WHEN event_type <> 'signup' THEN 'com.shop.Order.step' || (n % 3) END AS top_method, CASE WHEN event_type <> 'signup' THEN 'com.shop.Order.step' || (n % 3) || ' <- com.shop.Main.main' END AS top_stack, 't' || (n % 4) AS thread,
  CASE WHEN old OR event_type = 'click' THEN 'com.shop.C' || (n % 5) END AS class_name, CASE WHEN old OR event_type = 'click' THEN c * 100 ELSE 0 END AS size_bytes, CASE WHEN NOT old THEN 0 WHEN n % 50 = 1 THEN 64 + n % 3 WHEN n % 7 > 0 THEN n % 7 + n % 3 ELSE 0 END AS reference_depth, CASE WHEN old THEN c * 10 ELSE 0 END AS object_age_ms,
  CASE WHEN event_type2 <> 'jdk.CPULoad' THEN NULL WHEN n % 150 BETWEEN 2 AND 100 THEN (n % 150) / 100.0::DOUBLE ELSE (n % 150)::DOUBLE END AS machine_total, CASE WHEN event_type2 = 'jdk.CPULoad' THEN (n % 90) / 100.0::DOUBLE END AS jvm_total FROM t""")
def jfr_binary_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of each binary recording, depths of old objects walked in its pools."""
    binary = stored(rendered(spark, sf_dir), "recordings")
    depths = flight.reference_depths(recordings.decode(binary, "constants", flight.HELD))
    rows = jfr.timeline(flight.events(recordings.decode(binary), depths))
    return rows.drop("allocator", "root_type", "root_system", "root_description")


@query(f"""WITH {_ROWS}, o AS (SELECT artifact_id, n, CASE WHEN n % 50 = 1 THEN 70 ELSE n % 7 END AS steps FROM e WHERE event_type = 'purchase' AND n % 2 = 1), i AS (SELECT *, unnest(range(steps + 1)) AS i FROM o)
 SELECT artifact_id, n * 100 + i AS key, least(64, steps - i) + CASE WHEN i = 0 AND steps > 0 THEN n % 3 ELSE 0 END AS depth FROM i""")
def jfr_reference_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each sampled object, and each that holds one, is from its root."""
    return flight.reference_depths(recordings.decode(rendered(spark, sf_dir), "constants", flight.HELD)).drop("chunk_at")


_BASE = "startTime:long,duration:long,eventThread:java.lang.Thread"
_DECLARED = ", ".join(
    f"('{name}', '{label}', 'Java/{category}', '{fields}', '{kinds}', {part})"
    for name, label, category, fields, kinds, part in (
        ("jdk.JavaMonitorEnter", "Java Monitor Blocked", "Locks", f"{_BASE},stackTrace:jdk.types.StackTrace,monitorClass:java.lang.Class", "error", "-1"),
        ("jdk.ObjectAllocationSample", "Object Allocation Sample", "Memory", "startTime:long,eventThread:java.lang.Thread,stackTrace:jdk.types.StackTrace,objectClass:java.lang.Class,weight:long", "click", "-1"),
        ("jdk.ExecutionSample", "Method Profiling Sample", "Profiling", "startTime:long,sampledThread:java.lang.Thread,stackTrace:jdk.types.StackTrace", "view", "-1"),
        ("jdk.GCPhasePause", "GC Phase Pause", "Memory", f"{_BASE},stackTrace:jdk.types.StackTrace,gcId:int,name:java.lang.String", "purchase", "0"),
        ("jdk.OldObjectSample", "Old Object Sample", "Memory", f"{_BASE},stackTrace:jdk.types.StackTrace,objectAge:long,objectSize:long,object:jdk.types.OldObject", "purchase", "1"),
        ("jdk.ThreadPark", "Java Thread Park", "Locks", _BASE, "signup", "0"),
        ("jdk.CPULoad", "CPU Load", "Processor", f"{_BASE},jvmUser:double,jvmSystem:double,machineTotal:double", "signup", "1"),
        ("jdk.JVMInformation", "JVM Information", "Runtime", "startTime:long,jvmName:java.lang.String,jvmStartTime:long", "any", "-1"),
        ("jdk.InitialSystemProperty", "Initial System Property", "Runtime", "startTime:long,key:java.lang.String,value:java.lang.String", "signup", "0"),
        ("jdk.DataLoss", "Data Loss", "Runtime", "startTime:long,amount:long", "none", "-1"),
    )
)


@query(f"""WITH {_ROWS}, d(name, label, categories, fields, kinds, part) AS (VALUES {_DECLARED}), a AS (SELECT DISTINCT artifact_id FROM e)
 SELECT artifact_id, name, label, categories, len(string_split(fields, ',')) AS field_count, fields, kinds = 'any' OR EXISTS (SELECT 1 FROM e WHERE e.artifact_id = a.artifact_id AND e.event_type = kinds AND (part = -1 OR n % 2 = part)) AS observed FROM a, d""")
def jfr_declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events that each recording declares, their fields, and whether it has such events."""
    binary = stored(rendered(spark, sf_dir), "recordings")
    types = flight.types_of_declarations(recordings.decode(binary, "declarations"))
    silent = flight.types_without_events(types, recordings.decode(binary, "types")).select("artifact_id", "name", F.lit(False).alias("observed"))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ",")
    return types.join(silent, ["artifact_id", "name"], "left").select("artifact_id", "name", "label", F.array_join("categories", "/").alias("categories"), "field_count", fields.alias("fields"), F.coalesce("observed", F.lit(True)).alias("observed"))


@query(f"""WITH {_ROWS}, s AS (SELECT artifact_id, 'property:k' || (n % 5) AS k, arg_max('v' || n, {{'ms': ms, 'chunk': chunk, 'n': n}}) AS v FROM e WHERE event_type = 'signup' AND n % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT DISTINCT artifact_id, 'jvm:jvmName', 'Server VM' FROM e),
 m AS (SELECT artifact_id, string_agg(k || '=' || v, ';' ORDER BY k) AS settings FROM s GROUP BY 1), j AS (SELECT artifact_id, min(ms) AS ms FROM e GROUP BY 1)
 SELECT artifact_id, ms - 5000 AS jvm_start_ms, ms AS recording_start_ms, 5000::BIGINT AS start_offset_ms, settings FROM j JOIN m USING (artifact_id)""")
def jfr_runtime_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's JVM: its start, and its settings as they were told last."""
    info = flight.runtime_info(recordings.decode(rendered(spark, sf_dir)))
    return info.withColumn("settings", F.array_join(F.transform(F.map_entries("settings"), lambda s: F.concat_ws("=", s["key"], s["value"])), ";"))


@query(f"""WITH {_ROWS}, k AS (SELECT artifact_id, chunk, count(*) + 1 + count(*) FILTER (event_type = 'signup' AND n % 2 = 0) AS events, chunk % 2 = 1 AND artifact_id LIKE '%3' AS bad FROM e GROUP BY 1, 2)
 SELECT artifact_id, count(*) AS chunks, coalesce(sum(events) FILTER (NOT bad), 0)::BIGINT AS events, count(*) FILTER (bad) AS failed, CASE WHEN count(*) FILTER (bad) = 0 THEN 'PARSED' WHEN count(*) FILTER (NOT bad) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM k GROUP BY 1""")
def jfr_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its chunks and events, where some chunks were cut off."""
    bad = (F.col("chunk_at") % 2 == 1) & F.col("artifact_id").endswith("3")
    binary = rendered(spark, sf_dir).withColumn("content", F.when(bad, F.substring("content", 1, 500)).otherwise(F.col("content")))
    return flight.recordings(recordings.decode(binary, "chunks")).drop("error")
