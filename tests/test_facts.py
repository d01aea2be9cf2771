"""Summaries of several kinds through one table and back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heapstone.parse import gc, jfr, memory
from heapstone.sources import facts

PMAP = ["1:   java -jar a.jar", "Address           Kbytes     RSS   Dirty Mode  Mapping", "0000000000001000     400     200     100 rw---   [ anon ]", "0000000000002000     800       0       0 r-x--  libjvm.so", "total kB            1200     200     100"]
GC = ["[0.001s][info][gc] Using G1", "[1.000s][info][gc] GC(1) Pause Young (Normal) (G1 Evacuation Pause) 300M->100M(1024M) 5.0ms", "[2.000s][info][gc] GC(2) Pause Full (G1 Compaction Pause) 900M->800M(1024M) 50.0ms"]


def lines(spark, name, text):
    return spark.createDataFrame([(name, n, line) for n, line in enumerate(text, 1)], "artifact_id string, line_no int, line string")


@pytest.fixture(scope="module")
def summaries(spark):
    log = lines(spark, "g", GC)
    artifacts = spark.createDataFrame([("g", "\n".join(GC))], "artifact_id string, content string")
    recording = spark.createDataFrame([("j", "jdk.GCPhasePause", "2026-01-01T00:00:00Z", 300)], "artifact_id string, type string, startTime string, durationMs long")
    for name, kind in (("thread", "string"), ("className", "string"), ("bytes", "long"), ("allocator", "string"), ("rootType", "string"), ("rootSystem", "string"), ("rootDescription", "string"), ("referenceDepth", "long"), ("objectAgeMs", "long"), ("machineTotal", "double"), ("jvmTotal", "double"), ("stack", "array<struct<method:string,java:boolean>>")):
        recording = recording.withColumn(name, F.lit(None).cast(kind))
    return {"GC_LOG": gc.summary(artifacts, log), "PMAP": memory.pmap_summary(lines(spark, "m", PMAP)), "JFR": jfr.summary(jfr.timeline(recording))}


def test_every_summary_comes_back_as_it_was(spark, summaries, tmp_path):
    path = str(tmp_path / "facts")
    for kind, summary in summaries.items():
        facts.save(facts.canonical(summary, kind), path)
    assert facts.load(spark, path).count() == 3
    for kind, summary in summaries.items():
        columns = {f.name: f.dataType.simpleString() for f in summary.schema if f.name != "artifact_id"}
        back = facts.typed(facts.load(spark, path, kind), columns)
        assert back.schema.names == ["artifact_id", *columns] and [tuple(r) for r in back.collect()] == [tuple(r) for r in summary.select("artifact_id", *columns).collect()]


def test_what_is_present_by_kind(spark, summaries):
    every = facts.canonical(summaries["GC_LOG"], "GC_LOG").unionByName(facts.canonical(summaries["PMAP"], "PMAP"))
    found = {(r["kind"], r["field"]): (r["type"], r["n"]) for r in facts.present(every).collect()}
    assert found["GC_LOG", "collector"] == ("STRING", 1) and found["GC_LOG", "full_gc_count"] == ("BIGINT", 1) and found["PMAP", "rss_available"] == ("BOOLEAN", 1)
    assert ("GC_LOG", "max_allocation_stall_ms") not in found and ("PMAP", "collector") not in found
    odd = facts.typed(every, {"collector": "string", "full_gc_count": "long", "missing": "int", "rss_available": "int"}).collect()
    assert {(r["artifact_id"], r["collector"], r["full_gc_count"], r["missing"]) for r in odd} == {("g", "G1", 1, None), ("m", None, None, None)}


def test_nulls_kept_or_left_out(spark):
    rows = spark.createDataFrame([("a", None, 1)], "artifact_id string, x string, y int")
    told = lambda omit: facts.canonical(rows, "K", omit).select(F.to_json("facts").alias("j")).first()["j"]
    assert told(False) == '{"x":null,"y":1}' and told(True) == '{"y":1}'
