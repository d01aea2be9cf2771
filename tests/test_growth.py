"""Work that grows with the input and no faster: what is read once, shuffled once, opened once."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heapstone.operators import context
from heapstone.operators.context import Selector
from heapstone.operators.grouped import in_groups
from heapstone.parse import flight, threads
from heapstone.parse import gc as logs
from heapstone.plans import recorded
from heapstone.rulebook import correlation
from heapstone.sources import recordings
from heapstone.views import gc

START = 1_700_000_000_000


def events(first, n=20):
    kinds = ["error", "click", "view", "purchase", "signup"]
    return pa.Table.from_pylist([{"n": i, "c": i * 37 % 9000, "ms": START + i * 130, "kind": kinds[i * 7 % 5]} for i in range(first, first + n)])


@pytest.fixture(scope="module")
def binary(spark):
    """Thirty chunks of three recordings, one of them cut off."""
    rows = [(f"r{k % 3}", k // 3 * 1_000_000, recorded.render(events(20 * k))) for k in range(30)]
    rows[-1] = (*rows[-1][:2], rows[-1][2][:500])
    return spark.createDataFrame(rows, "artifact_id string, chunk_at long, content binary").repartition(2)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_that_cross_batches_are_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("k"), (F.col("id") % 3).alias("m"), (500 - F.col("id")).alias("v"))

        def work(t):
            return pa.table({"k": t["k"][:1], "m": t["m"][:1], "n": pa.array([t.num_rows]), "v": pa.array([t["v"].to_pylist()], pa.list_(pa.int64()))})

        found = {(r["k"], r["m"]): (r["n"], r["v"]) for r in in_groups(rows, ["k", "m"], ["v"], work, "k string, m long, n long, v array<long>").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in rows.collect():
        want.setdefault((r["k"], r["m"]), []).append(r["v"])
    assert found == {key: (len(v), sorted(v)) for key, v in want.items()} and len(found) == 15


def test_small_chunks_share_batches_and_declarations():
    chunks = [("a", k, recorded.render(events(20 * k))) for k in range(30)]
    assert len(list(recordings._batches("chunks", iter(chunks)))) == 1
    told = [b.to_pylist() for b in recordings._batches("declarations", iter(chunks))][0]
    assert len({r["digest"] for r in told}) == 1 and [r["declared"] is None for r in told] == [False] + [True] * 29


def test_walks_read_the_constants_once(binary):
    depths = flight.reference_depths(recordings.decode(binary, "constants", flight.HELD))
    assert plan(depths).count("MapInArrow") == 2 and "Join" not in plan(depths)
    assert {tuple(r) for r in depths.collect()} == {tuple(r) for r in flight.reference_depths(recordings.decode(binary, "constants")).collect()} and depths.count() > 30


def test_settings_and_times_come_from_one_reading(binary):
    info = flight.runtime_info(recordings.decode(binary))
    assert plan(info).count("MapInArrow") == 1
    rows = {r["artifact_id"]: r for r in info.collect()}
    assert {k: (r["jvm_start_ms"], r["recording_start_ms"], r["start_offset_ms"]) for k, r in rows.items()} == {f"r{k}": (START + 20 * k * 130 - 5000, START + 20 * k * 130, 5000) for k in range(3)}
    for k, r in rows.items():
        last = {s["kind"] + ":" + s["name"]: s["value"] for s in flight.settings(recordings.decode(binary)).where(F.col("artifact_id") == k).collect()}
        assert r["settings"] == last and "jvm:jvmName" in last


def test_equal_declarations_are_opened_once(spark, binary):
    of = lambda df: sorted(map(str, df.select("artifact_id", "name", "label", "description", "categories", "field_count", "fields").collect()))
    found = flight.types_of_declarations(recordings.decode(binary, "declarations"))
    assert of(found) == of(flight.declared_types(recordings.decode(binary, "elements"))) and found.count() == 30
    counts = recordings.decode(binary, "types").groupBy("artifact_id", "type").agg(F.sum("events").alias("n"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in recordings.decode(binary).groupBy("artifact_id", "type").count().collect()}


DUMP = """\"app-1\" #1 prio=5 cpu=10.00ms elapsed=5.00s tid=0x1 nid=0x1 waiting
   java.lang.Thread.State: BLOCKED (on object monitor)
\tat com.shop.A.b(A.java:1)
\t- waiting to lock <0x0a> (a X)

\tat com.shop.After.end(A.java:1)
\"worker-2\" #2 daemon prio=5 nid=0x2 runnable
   java.lang.Thread.State: RUNNABLE
\tat com.shop.C.d(C.java:1)
\t- locked <0x0a> (a X)
\t- locked <0x0b> (a X)
\"worker-3\" #3 prio=5 nid=0x3
   java.lang.Thread.State: WAITING (parking)
\tat java.util.concurrent.ForkJoinTask.join(F.java:1)
\t- parking to wait for  <0x0a> (a X)

Found one Java-level deadlock:
=============================
\"app-1\":
  waiting to lock monitor
Java stack information for the threads listed above:
\"worker-2\":
"""


def test_threads_and_monitors_from_one_shuffle_of_the_lines(spark):
    lines = spark.createDataFrame([("t", k + 1, x) for k, x in enumerate(DUMP.split("\n"))], "artifact_id string, line_no int, line string")
    rows = threads.threads(lines)
    got = {r["name"]: (r["state"], r["top_frame"], r["deadlocked"], r["in_join"], r["locked"], r["line_no"]) for r in rows.collect()}
    assert got == {"app-1": ("BLOCKED", "com.shop.A.b(A.java:1)", True, False, [], 1), "worker-2": ("RUNNABLE", "com.shop.C.d(C.java:1)", False, False, ["0x0a", "0x0b"], 7), "worker-3": ("WAITING", "java.util.concurrent.ForkJoinTask.join(F.java:1)", False, True, [], 12)}
    spots = threads.hotspots(rows)
    assert [tuple(r) for r in spots.collect()] == [("t", "0x0a", 2, 1, ["app-1", "worker-3"], "worker-2", "RUNNABLE")]
    assert plan(spots).count("Window [") <= 2 and plan(spots).count("Join") <= 1


def test_lines_are_not_copied_for_each_of_their_words(spark):
    lines = spark.createDataFrame([(1, k, f"x{k} alpha beta gamma{k % 3} delta y") for k in range(1, 7)], "doc_id long, line_no int, line string")
    found = context.snippet_lines(lines, ["doc_id"], spark.createDataFrame([(1, "alpha beta gamma1 delta"), (1, "beta gamma2")], "doc_id long, snippet string"))
    assert {r["snippet"]: r["line_numbers"] for r in found.collect()} == {"alpha beta gamma1 delta": [1, 4], "beta gamma2": [2, 5]}
    exploded = [x for x in plan(found).splitlines() if "Generate explode" in x]
    assert exploded and all(re.search(r"\), \[\d", x) for x in exploded)  # the line is dropped where its words are made


def test_sums_of_pauses_do_not_show_their_order(spark):
    rows = [("g", "pause", "Metadata GC Threshold", "FULL", 0.1)] * 3 + [("g", "pause", "other", "YOUNG", 0.7)]
    frame = spark.createDataFrame(rows, "artifact_id string, kind string, cause string, pause_type string, amount_ms double").coalesce(1)
    found = gc.pause_focus(frame, Selector.parse("cause=metadata; pauseType=full")).first()
    assert (found["n"], found["total_ms"], found["max_ms"], found["p95_ms"], found["share"]) == (3, 0.3, 0.1, 0.1, 0.3)


def test_percentiles_of_a_focus_count_pauses_of_no_time(spark):
    rows = [("g", "pause", "Metadata GC Threshold", "FULL", ms) for ms in (0.0, 0.0, 3.0, 5.0)] + [("h", "pause", "Metadata GC Threshold", "FULL", 0.0), ("h", "pause", "other", "YOUNG", 2.0)]
    frame = spark.createDataFrame(rows, "artifact_id string, kind string, cause string, pause_type string, amount_ms double")
    found = gc.pause_focus(frame, Selector.parse("cause=metadata; pauseType=full"))
    assert {r["artifact_id"]: (r["n"], r["max_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["share"]) for r in found.collect()} == {"g": (4, 5.0, 0.0, 5.0, 5.0, 1.0), "h": (1, 0.0, 0.0, 0.0, 0.0, 0.0)}


def test_rules_of_an_incident_read_its_findings_once(spark):
    rng = random.Random(15)
    ids = sorted({x for rule in correlation.RULES for group in (*rule.needs, rule.blocked) for x in group if not x.startswith("state:")} | {"unknown"})
    sets = {i: set(rng.sample(ids, i % 40)) for i in range(300)}
    findings = spark.createDataFrame([(i, x) for i, held in sets.items() for x in (*held, None)], "incident int, finding_id string")
    want = set()
    for i, held in sets.items():
        has = lambda group, held=held: not held.isdisjoint(group)
        if not (has(["nmt-reserved-committed-mismatch"]) and has(["pmap-virtual-resident-mismatch"])) or has(correlation._ACTIVE):
            held.add("state:native-pressure-open")
        if has(correlation._RETENTION) or has(correlation._ALLOCATION) and has(["jfr-gc-pause-events", *correlation._GC, "gc-heap-saturation"]):
            held.add("state:jfr-heap-side")
        for k, rule in enumerate(correlation.RULES):
            if all(map(has, rule.needs)) and not has(rule.blocked):
                want.add((i, rule.id, next((name for name, group in rule.levels if has(group)), rule.otherwise), k))
                held.add(rule.id)
    found = correlation.correlate_incident(findings, ["incident"])
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 300
    assert "Union" not in plan(found) and "collect_set" not in plan(found) and plan(found).count("Aggregate") == 1


LOG = """[0.001s][info][gc] Using G1
[1.000s][info][gc] GC(1) Pause Young (Normal) (G1 Evacuation Pause) 1.5G->300M(2048M) 12.5ms
[1.500s][info][gc] GC(2) To-space exhausted
[1.600s][info][gc] Allocation Stall (worker-1) 3.25ms
[1.700s][info][gc,phases] GC(3) Concurrent Mark 7.125ms
[1.800s][info][gc,task] GC(4) Using 3 workers of 16 for evacuation
2024-01-01T00:00:01.000+0000: 2.234: [GC pause (G1 Evacuation Pause) (young)
   [Parallel Time: 1.0 ms]
   [Eden: 10.0M(10.0M)->0.0B(8.0M) Survivors: 0.0B->2.0M Heap: 10.0M(64.0M)->5.0M(64.0M)]
, 0.0123 secs]
[Times: user=0.01 sys=0.00, real=0.01 secs]
3.500: [Full GC (Ergonomics) [PSYoungGen: 10K->0K(20K)] [ParOldGen: 30K->20K(40K)] 40K->20K(60K), [Metaspace: 5K->5K(8K)], 0.5000 secs] [Times: user=0.50 sys=0.00, real=0.50 secs]
nothing""".split("\n")


def test_lines_are_read_once_for_stored_events(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [("g", n, line) for n, line in enumerate(LOG, 1)]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "artifact_id string, line_no int, line string")
    stored = logs.stored_events(lines)
    assert read.value == len(LOG)
    assert sorted(map(str, stored.collect())) == sorted(map(str, logs.events(lines).collect())) and stored.columns == logs.events(lines).columns
    paused = {r["line_no"]: (r["amount_ms"], r["before_bytes"], r["after_bytes"], r["capacity_bytes"], r["pause_type"]) for r in stored.where("kind = 'pause'").collect()}
    assert paused == {2: (12.5, 3 << 29, 300 << 20, 2 << 30, "YOUNG"), 7: (12.3, 10 << 20, 5 << 20, 64 << 20, "YOUNG"), 12: (500.0, 40 << 10, 20 << 10, 60 << 10, "FULL")}
    assert {r["kind"] for r in stored.collect()} == {"pause", "signal", "stall", "phase", "worker", "cpu", "metaspace"}


def test_only_the_columns_that_a_window_needs_are_stored(spark):
    lines = spark.createDataFrame([("g", n, line) for n, line in enumerate(LOG, 1)], "artifact_id string, line_no int, line string")
    some = ["artifact_id", "line_no", "elapsed_s", "kind"]
    found = logs.stored_events(lines, some)
    assert found.columns == some and sorted(map(str, found.collect())) == sorted(map(str, logs.events(lines).select(*some).collect()))
    assert "user" not in plan(found) and "phase_kind" not in plan(found)


def test_code_of_the_parser_is_small_enough_to_be_compiled(spark):
    lines = spark.range(9).selectExpr("'g' AS artifact_id", "CAST(id AS INT) AS line_no", "concat('x', id) AS line")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(logs._single(lines, logs._kinds(), True)._jdf.queryExecution().executedPlan()))
    assert sizes and max(map(int, sizes)) <= 8000  # the JVM leaves longer methods to its interpreter


def test_a_summary_stores_only_what_it_reads(spark, monkeypatch):
    lines = spark.createDataFrame([("g", n, line) for n, line in enumerate(LOG, 1)], "artifact_id string, line_no int, line string")
    every, held = logs.stored_events(lines), []
    monkeypatch.setattr(logs, "stored", lambda df, name: held.append((name, df.columns)) or df)
    found = logs.summary(spark.createDataFrame([("g", LOG[0])], "artifact_id string, content string"), lines)
    assert dict(held)["gc-events"] and not {"mmu_2ms", "thread", "purpose", "signal", "phase", "abs_ts"} & set(dict(held)["gc-events"])
    row = found.first()
    assert row == logs.summary_of(logs.collectors(spark.createDataFrame([("g", LOG[0])], "artifact_id string, content string")), every).first()
    assert (row["pause_count"], row["full_gc_count"], row["to_space_exhausted_count"], row["collector"], row["median_pause_ms"]) == (3, 1, 1, "G1", 12.5)
