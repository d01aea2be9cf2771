"""Binary recordings: the format against a writer of our own and against a JVM's, chunks that are broken, walks of references, declared types, settings."""

from __future__ import annotations

import datetime
import json
import os
import shutil
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heapstone.parse import flight, jfr
from heapstone.plans.recorded import TYPES, render
from heapstone.sources import flight_writer, recordings
from heapstone.sources.flight_writer import Declared

START = 1_700_000_000_000_000_000


@pytest.mark.parametrize("value", [0, 1, 127, 128, 300, 2**31, 2**55, 2**56, 2**62, 2**63 - 1, -1, -(2**63), -300])
def test_numbers_keep_their_value(value):
    cursor = recordings.Cursor(flight_writer.varint(value) + b"x")
    assert cursor.varint() == value and cursor.at == len(cursor.data) - 1 <= 9


def test_texts_in_every_encoding():
    read = lambda data: recordings.Cursor(data).text()
    assert read(b"\0") is None and read(b"\1") == "" and read(flight_writer.text("añ漢🙂")) == "añ漢🙂"
    assert read(b"\2" + flight_writer.varint(9)) == recordings.Ref("java.lang.String", 9)
    assert read(b"\4" + flight_writer.varint(2) + flight_writer.varint(0xD83D) + flight_writer.varint(0xDE42)) == "🙂"
    assert read(b"\5" + flight_writer.varint(2) + b"a\xe9") == "aé"
    with pytest.raises(recordings.Unreadable):
        read(b"\7")
    with pytest.raises(recordings.Unreadable):
        read(b"\3" + flight_writer.varint(50) + b"short")


def rows(n=200):
    import pyarrow as pa

    kinds = ["error", "click", "view", "purchase", "signup"]
    data = [{"n": i, "c": i * 37 % 9000, "ms": START // 1_000_000 + i * 130, "kind": kinds[i * 7 % 5]} for i in range(n)]
    return data, pa.Table.from_pylist(data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two recordings of several chunks, one of them with a chunk cut off, and files that are none."""
    path = tmp_path_factory.mktemp("recordings")
    _, table = rows()
    one, two, three = render(table.slice(0, 80)), render(table.slice(80, 60)), render(table.slice(140))
    (path / "sub").mkdir()
    (path / "a.jfr").write_bytes(one + two + three)
    (path / "sub" / "b.jfr").write_bytes(one + two[:-9])
    (path / "sub" / "c.jfr").write_bytes(b"not a recording")
    (path / "d.jfr").write_bytes(b"")
    (path / "notes.txt").write_text("FLR")
    return path


def test_a_task_for_each_chunk_and_a_row_for_each_that_fails(spark, folder):
    found = recordings.read(spark, str(folder), "chunks").collect()
    told = {(os.path.basename(r["artifact_id"]), r["chunk_at"] > 0): (r["events"], bool(r["error"])) for r in found}
    assert len(found) == 6 and told["b.jfr", True] == (0, True) and told["c.jfr", False] == (0, True) and told["b.jfr", False][0] > 80
    files = {os.path.basename(r["artifact_id"]): (r["status"], r["chunks"], r["failed"]) for r in flight.recordings(recordings.read(spark, str(folder), "chunks")).collect()}
    assert files == {"a.jfr": ("PARSED", 3, 0), "b.jfr": ("PARTIAL", 2, 1), "c.jfr": ("FAILED", 1, 1)}
    recordings.register(spark)
    each = spark.read.format("flight_recording").option("part", "events").option("taskBytes", "1").load(f"file://{folder}/a.jfr")
    assert each.rdd.getNumPartitions() == 3
    assert each.count() == sum(r["events"] for r in found if r["artifact_id"].endswith("a.jfr"))
    assert {os.path.basename(r["artifact_id"]) for r in recordings.read(spark, str(folder)).collect()} == {"a.jfr", "b.jfr"}
    with pytest.raises(Exception, match="part must be one of"):
        spark.read.format("flight_recording").option("part", "all").load(str(folder)).schema  # noqa: B018


def test_the_timeline_is_that_of_its_json_lines(spark, folder, tmp_path):
    data, _ = rows()
    names = {"error": "jdk.JavaMonitorEnter", "click": "jdk.ObjectAllocationSample", "view": "jdk.ExecutionSample"}
    lines = []
    for r in data:
        n, c, kind = r["n"], r["c"], r["kind"]
        odd, old = n % 2 == 1, kind == "purchase" and n % 2 == 1
        name = names.get(kind) or (("jdk.OldObjectSample" if odd else "jdk.GCPhasePause") if kind == "purchase" else ("jdk.CPULoad" if odd else "jdk.ThreadPark"))
        when = datetime.datetime.fromtimestamp(r["ms"] / 1000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        depth = (64 + n % 3 if n % 50 == 1 else n % 7 + n % 3 if n % 7 else 0) if old else None
        event = {"type": name, "startTime": when, "durationMs": None if kind in ("click", "view") else c // 10, "thread": f"t{n % 4}", "referenceDepth": depth}
        event |= {"className": f"com.shop.C{n % 5}", "bytes": c * 100} if old or kind == "click" else {}
        event |= {"objectAgeMs": c * 10} if old else {}
        event |= {"machineTotal": float(n % 150), "jvmTotal": (n % 90) / 100} if name == "jdk.CPULoad" else {}
        event |= {} if kind == "signup" else {"stack": [{"method": f"com.shop.Order.step{n % 3}", "java": True}, {"method": "com.shop.Main.main", "java": True}]}
        lines.append(json.dumps(event))
    (tmp_path / "a.json").write_text("\n".join(lines))
    want = jfr.timeline(jfr.read(spark, str(tmp_path / "a.json"))).drop("artifact_id")
    at = str(folder / "a.jfr")
    depths = flight.reference_depths(recordings.read(spark, at, "constants"))
    found = jfr.timeline(flight.events(recordings.read(spark, at), depths)).drop("artifact_id")
    assert found.columns == want.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))


def test_walks_of_a_chain_a_cycle_a_star_and_a_broken_one(spark):
    """Against a plain walk of at most 64 steps."""
    objects: dict[int, tuple[int, int | None] | None] = {}
    for i in range(100):
        objects[i] = (0, i + 1) if i < 99 else None  # a chain longer than a walk
    for i in range(5):
        objects[200 + i] = (i, 200 + (i + 1) % 5)  # a cycle with skips
    objects[300] = None
    objects |= {301 + i: (2, 300) for i in range(40)}  # a star
    objects[400], objects[401] = (7, None), (0, 999)  # a reference to nothing, and to an object that isn't there

    def walk(key):
        depth = 0
        for _ in range(64):
            link = objects.get(key)
            if link is None:
                return depth
            depth += 1 + link[0]
            if link[1] is None:
                return depth
            key = link[1]
        return depth

    data = []
    for key, link in objects.items():
        data.append(("r", 0, "jdk.types.OldObject", key, {"referrer": str(key + 1)} if link else {"address": "0"}))
        if link:
            data.append(("r", 0, "jdk.types.Reference", key + 1, {"skip": str(link[0])} | ({} if link[1] is None else {"object": str(link[1])})))
    frame = spark.createDataFrame(data, recordings.SCHEMAS["constants"])
    found = {r["key"]: r["depth"] for r in flight.reference_depths(frame).collect()}
    assert found == {key: walk(key) for key in objects} and found[0] == 64 and found[200] > 64
    assert flight.reference_depths(frame.where("false")).count() == 0


def test_declared_types_with_fields_and_without_events(spark, folder):
    types = flight.declared_types(recordings.read(spark, str(folder / "a.jfr"), "elements"))
    found = {r["name"]: r for r in types.collect()}
    assert set(found) == {t.name for t in TYPES if t.above}
    lost = found["jdk.DataLoss"]
    assert (lost["label"], lost["categories"], lost["field_count"]) == ("Data Loss", ["Java", "Runtime"], 2)
    assert [(f["name"], f["label"], f["type"]) for f in lost["fields"]] == [("startTime", "Start Time", "long"), ("amount", None, "long")]
    assert {f["name"]: f["description"] for f in found["jdk.ThreadPark"]["fields"]}["eventThread"] == "Thread of the event"
    assert [r["name"] for r in flight.types_without_events(types, recordings.read(spark, str(folder / "a.jfr"))).collect()] == ["jdk.DataLoss"]


def test_settings_are_those_told_last(spark):
    row = lambda chunk, at, kind, ns, **fields: ("r", chunk, at, kind, None, ns, None, None, None, fields)
    data = [
        row(0, 100, "jdk.JVMInformation", START, jvmName="old", jvmStartTime=str(START - 7_000_000_000)), row(900, 100, "jdk.JVMInformation", START + 5, jvmName="new", jvmStartTime=str(START - 2_000_000_000)), row(0, 90, "jdk.BooleanFlag", START, name="UseG1GC", value="true"),
        row(0, 95, "jdk.BooleanFlag", START, name="UseG1GC", value="false"), row(0, 97, "jdk.InitialSystemProperty", START, key="a", value="1"), row(0, 98, "jdk.InitialSystemProperty", START - 1, key="a", value="2"), row(0, 99, "jdk.InitialSystemProperty", START, key=None, value="3"),
    ]
    other = ("s", 0, 1, "jdk.CPULoad", None, START, None, None, None, {})
    found = {r["artifact_id"]: r for r in flight.runtime_info(spark.createDataFrame([*data, other], recordings.SCHEMAS["events"])).collect()}
    mine = found["r"]
    assert mine["settings"] == {"flag:UseG1GC": "false", "jvm:jvmName": "new", "property:a": "1"}
    assert (mine["jvm_start_ms"], mine["start_offset_ms"]) == ((START - 7_000_000_000) // 1_000_000, 6999)
    assert found["s"]["jvm_start_ms"] is None and found["s"]["start_offset_ms"] is None and found["s"]["settings"] == {}


def test_candidates_are_tried_in_order(spark):
    row = lambda kind, **fields: ("r", 0, 0, kind, None, START, None, "t", None, fields)
    data = [
        row("jdk.ObjectAllocationOutsideTLAB", tlabSize="99", allocationSize="0", weight="5"), row("my.ObjectAllocation", allocatedTypeName="a.B", poolSize="77", pathContext="loop"), row("jdk.ClassLoad", definedClass="x.Y", metadataBytes="12"),
        row("jdk.OldObjectSample", **{"object": "3", "object.type": "x.Z", "root.type": "Stack", "objectAge": "4500000", "depth": "2"}), row("jdk.CPULoad", jvmUser="0.75", jvmSystem="0.5", machineTotal="oops"), row("jdk.SocketRead", weight="9"),
    ]
    found = {r["type"]: r for r in flight.events(spark.createDataFrame(data, recordings.SCHEMAS["events"])).collect()}
    assert found["jdk.ObjectAllocationOutsideTLAB"]["bytes"] == 5 and found["my.ObjectAllocation"]["className"] == "a.B"
    assert (found["my.ObjectAllocation"]["bytes"], found["my.ObjectAllocation"]["allocator"]) == (77, "loop")
    assert (found["jdk.ClassLoad"]["className"], found["jdk.ClassLoad"]["bytes"]) == ("x.Y", 12)
    old = found["jdk.OldObjectSample"]
    assert (old["className"], old["rootType"], old["objectAgeMs"], old["referenceDepth"]) == ("x.Z", "Stack", 4, 2)
    assert found["jdk.CPULoad"]["jvmTotal"] == 1.0 and found["jdk.CPULoad"]["machineTotal"] is None and found["jdk.SocketRead"]["bytes"] is None


def test_a_chunk_that_lies_is_an_error_not_an_exception():
    _, table = rows(30)
    good = render(table)
    for at in range(0, len(good), 7):  # one byte wrong anywhere
        data = bytearray(good)
        data[at] ^= 0x55
        found = recordings._checked("chunks", bytes(data))
        assert len(found) == 1
        recordings._checked("events", bytes(data))
    assert recordings._checked("events", good[:-1]) == []


def test_arrays_floats_and_nested_objects():
    types = [
        Declared("my.Event", [("startTime", "long", False, False, {"jdk.jfr.Timestamp": {"value": "TICKS"}}), ("many", "int", False, True, {}), ("part", "my.Part", False, False, {}), ("wait", "long", False, False, {"jdk.jfr.Timespan": {"value": "MILLISECONDS"}}), ("f", "float", False, False, {}), ("b", "byte", False, False, {}), ("on", "boolean", False, False, {})], "jdk.jfr.Event"),
        Declared("my.Part", [("x", "int", False, False, {}), ("y", "java.lang.String", False, False, {})]),
    ]
    chunk = flight_writer.Chunk(types, START)
    chunk.event("my.Event", startTime=START + 3, many=[1, -2], part={"x": -4, "y": None}, wait=5, f=0.5, b=-3, on=True)
    ((at, name, _, start, duration, thread, stack, fields),) = recordings._checked("events", chunk.bytes())
    assert (at, name, start, duration, thread, stack) == (68, "my.Event", START + 3, None, None, None)
    assert dict(fields) == {"many": "1,-2", "part.x": "-4", "wait": "5000000", "f": "0.5", "b": "-3", "on": "true"}


@pytest.mark.skipif(not shutil.which("java") or not shutil.which("jfr"), reason="needs a JVM with its recording tool")
def test_a_recording_of_a_real_jvm_reads_as_its_own_tool_prints_it(spark, tmp_path):
    (tmp_path / "Busy.java").write_text("public class Busy { static synchronized void a() throws Exception { Thread.sleep(30); } public static void main(String[] x) throws Exception { for (int i = 0; i < 3; i++) new Thread(() -> { try { for (int k = 0; k < 8; k++) a(); } catch (Exception e) {} }, \"busy-\" + i).start(); } }")
    at = tmp_path / "real.jfr"
    made = subprocess.run(["java", f"-XX:StartFlightRecording=filename={at},settings=profile", str(tmp_path / "Busy.java")], capture_output=True, timeout=120)
    if made.returncode or not at.exists():
        pytest.skip("this JVM records nothing")
    printed = json.loads(subprocess.run(["jfr", "print", "--json", "--stack-depth", "64", str(at)], capture_output=True, text=True, timeout=120).stdout)["recording"]["events"]

    def nanos(text):
        whole, _, part = text.rstrip("Z").partition(".")
        return int(datetime.datetime.fromisoformat(whole.split("+")[0] + "+00:00").timestamp()) * 10**9 + int(part.split("+")[0].split("-")[0].ljust(9, "0") or 0)

    want = Counter()
    for event in printed:
        values = event["values"]
        thread = next((values[k] for k in ("eventThread", "sampledThread", "thread") if isinstance(values.get(k), dict)), None)
        frames = (values.get("stackTrace") or {}).get("frames") or []
        want[event["type"], nanos(values["startTime"]), (thread.get("javaName") or thread.get("osName")) if thread else None, tuple(f["method"]["type"]["name"].replace("/", ".") + "." + f["method"]["name"] for f in frames)] += 1
    events = recordings.read(spark, str(at))
    found = Counter((r["type"], r["start_ns"], r["thread"], tuple(f["method"] for f in r["stack"] or [])) for r in events.collect())
    assert found == want and len(printed) > 500
    info = flight.runtime_info(events).first()
    assert info["start_offset_ms"] > 0 and "flag:UseG1GC" in info["settings"] and "jvm:jvmVersion" in info["settings"]
    assert {"jdk.ThreadPark", "jdk.JavaMonitorEnter"} <= {r["name"] for r in flight.declared_types(recordings.read(spark, str(at), "elements")).collect()}
    assert {r["signal_family"] for r in jfr.timeline(flight.events(events)).select("signal_family").distinct().collect()} >= {"lockContention", "generic"}
    assert flight.recordings(recordings.read(spark, str(at), "chunks")).first()["status"] == "PARSED"
