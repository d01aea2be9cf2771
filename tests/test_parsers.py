"""Parsers and rules on small inline artifacts, with pinned numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heapstone.operators.context import Selector, Session, lines
from heapstone.operators.rules import correlate
from heapstone.parse import gc, incidents, jfr, memory, threads
from heapstone.rulebook import assessment, comparison, correlation
from heapstone.sources import artifacts, reports

G1 = """[2025-11-02T08:30:00.000+0000][0.250s][info][gc] Using G1
[2025-11-02T08:30:01.500+0000][1.750s][info][gc] GC(11) Pause Young (Normal) (G1 Evacuation Pause) 410M->300M(500M) 12.500ms
[2025-11-02T08:30:03.000+0000][3.250s][info][gc] GC(12) Pause Young (Mixed) (G1 Evacuation Pause) 450M->430M(500M) 22.500ms
[2025-11-02T08:30:04.500+0000][4.750s][info][gc] GC(13) Pause Full (G1 Compaction Pause) 499M->490M(500M) 150.000ms
"""
CYCLE = """[0.250s][info][gc] Using G1
[1.500s][info][gc] GC(21) Pause Young (Normal) (G1 Evacuation Pause) 600M->500M(800M) 15.000ms
[2.500s][info][gc] GC(22) Pause Young (Mixed) (G1 Evacuation Pause) 760M->700M(800M) 18.000ms
[3.500s][info][gc] GC(23) Pause Young (Mixed) (G1 Evacuation Pause) 770M->720M(800M) 21.000ms
[4.500s][info][gc] GC(24) Pause Full (G1 Compaction Pause) 795M->785M(800M) 90.000ms
[5.500s][info][gc] GC(25) Pause Full (G1 Compaction Pause) 798M->790M(800M) 95.000ms
"""
ZGC = """[0.030s][info][gc,init] Initializing The Z Garbage Collector
[0.410s][info][gc,task     ] GC(0) Using 3 workers
[0.450s][info][gc,phases   ] GC(0) Concurrent Mark 14.250ms
[0.470s][info][gc,mmu      ] GC(0) MMU: 2ms/91.5%, 5ms/95.0%, 10ms/97.5%, 20ms/98.0%, 50ms/99.0%, 100ms/99.5%
[0.520s][info][gc          ] GC(0) Garbage Collection (Proactive) 64M(12%)->16M(3%)
[0.610s][info][gc          ] Allocation Stall (main) 7.250ms
[0.740s][info][gc          ] Allocation Stall (main) 3.500ms
[0.870s][info][gc          ] Allocation Stall (worker-4) 12.000ms
[0.910s][info][gc,metaspace] GC(0) Metaspace: 9100K(10240K)->9100K(10240K) NonClass: 5000K(5120K)->5000K(5120K)
"""
CMS = """2025-12-05T14:20:00.250+0000: 2.250: [CMS-concurrent-mark: 0.080/0.300 secs] [Times: user=0.25 sys=0.01, real=0.30 secs]
2025-12-05T14:20:01.000+0000: 3.000: [Full GC (concurrent mode failure) [CMS: 194500K->193600K(196608K)] 195000K->193600K(196608K), 0.1500000 secs] [Times: user=0.18 sys=0.00, real=0.15 secs]
2025-12-05T14:20:02.000+0000: 4.000: [Full GC (concurrent mode failure) [CMS: 194600K->193700K(196608K)] 195100K->193700K(196608K), 0.1700000 secs] [Times: user=0.20 sys=0.00, real=0.17 secs]
2025-12-05T14:20:03.000+0000: 5.000: [Full GC (concurrent mode failure) [CMS: 194700K->193800K(196608K)] 195200K->193800K(196608K), 0.2100000 secs] [Times: user=0.22 sys=0.00, real=0.21 secs]
"""
LEGACY = """2025-12-05T14:00:00.000+0000: 1.250: [GC pause (G1 Evacuation Pause) (young) (initial-mark), 0.0082500 secs]
   [Parallel Time: 6.5 ms, GC Workers: 8]
   [Eden: 24.0M(24.0M)->0.0B(20.0M) Survivors: 3.0M->4.0M Heap: 90.0M(128.0M)->70.0M(128.0M)]
 [Times: user=0.04 sys=0.01, real=0.01 secs]
"""


def table(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "artifact_id string, content string")


@pytest.fixture(scope="module")
def gc_summary(spark):
    """One summary of all logs, computed once."""
    rows = table(spark, g1=G1, cycle=CYCLE, zgc=ZGC, cms=CMS, slow=CYCLE.replace("15.000ms", "615.000ms"))
    made = gc.summary(rows, lines(rows, ["artifact_id"], "content"))
    return spark.createDataFrame(made.collect(), made.schema)


@pytest.fixture(scope="module")
def gc_rows(gc_summary):
    return {r["artifact_id"]: r for r in gc_summary.collect()}


@pytest.fixture(scope="module")
def gc_findings(gc_summary):
    found = {}
    for r in assessment.assess("GC_LOG", gc_summary).collect():
        found.setdefault(r["artifact_id"], {})[r["finding_id"]] = r["severity"]
    return found


def test_g1_recovery_and_causes(spark, gc_rows):
    s = gc_rows["g1"]
    assert (s["collector"], s["pause_count"], s["young_count"], s["mixed_count"], s["full_gc_count"]) == ("G1", 3, 1, 1, 1)
    assert (s["dominant_cause_by_count"], s["dominant_cause_by_total_ms"]) == ("G1 Evacuation Pause", "G1 Compaction Pause")
    assert (s["high_retained_count"], s["near_capacity_count"], s["near_capacity_streak"]) == (2, 1, 1)
    assert s["average_reclaimed_mb"] == pytest.approx(139 / 3) and s["average_full_post_gc_occupancy_ratio"] == pytest.approx(0.98) and s["p95_pause_ms"] == 150.0
    rows = {r["cause"]: r["total_ms"] for r in gc.breakdown(gc.pauses(lines(table(spark, a=G1), ["artifact_id"], "content")), "cause").collect()}
    assert rows == {"G1 Evacuation Pause": 35.0, "G1 Compaction Pause": 150.0}


def test_g1_progression(gc_rows):
    s = gc_rows["cycle"]
    assert (s["young_before_first_mixed_count"], s["mixed_before_first_full_count"], s["full_after_mixed_count"], s["high_retained_mixed_count"]) == (1, 2, 2, 2)
    assert (s["low_reclaim_full_count"], s["low_reclaim_full_streak"]) == (2, 2)
    assert s["average_full_gc_reclaimed_mb"] == pytest.approx(9.0) and s["average_full_gc_reclaimed_share"] == pytest.approx(0.01125)


def test_zgc_lines_and_rules(spark, gc_rows, gc_findings):
    r = gc_rows["zgc"]
    assert (r["collector"], r["allocation_stall_count"], r["max_allocation_stall_ms"], r["total_allocation_stall_ms"], r["gc_cycle_count"], r["concurrent_phase_count"], r["max_active_workers"]) == ("ZGC", 3, 12.0, 22.75, 1, 1, 3)
    assert gc_findings["zgc"] == {"gc-allocation-stall-pressure": "HIGH"}
    mmu = gc.mmu(lines(table(spark, a=ZGC), ["artifact_id"], "content")).first()
    assert (mmu["mmu_2ms"], mmu["mmu_100ms"]) == (91.5, 99.5)


def test_cms_and_legacy_logs(spark, gc_rows, gc_findings):
    s = gc_rows["cms"]
    assert (s["collector"], s["full_gc_count"], s["concurrent_mode_failure_count"], s["max_full_gc_pause_ms"], s["cpu_sample_count"]) == ("CMS", 3, 3, pytest.approx(210.0), 4)
    assert set(gc_findings["cms"]) == {"gc-repeated-full-gcs", "gc-heap-saturation"}
    p = gc.pauses(lines(table(spark, a=LEGACY), ["artifact_id"], "content")).collect()
    assert [(r["pause_type"], r["pause_ms"], r["after_mb"], r["capacity_mb"]) for r in p] == [("INIT_MARK", pytest.approx(8.25), 70, 128)]


def test_gc_regression_pair(spark, gc_summary):
    pairs = spark.createDataFrame([(1, "g1", "slow")], "pair_id int, baseline_id string, current_id string")
    found = {r["finding_id"]: r["severity"] for r in comparison.compare("GC_LOG", pairs, gc_summary).collect()}
    assert found["compare-gc-pause-regression"] == "CRITICAL" and found["compare-gc-full-gc-regression"] == "CRITICAL" and "compare-gc-collector-change" not in found and found["compare-gc-g1-distress-regression"] == "HIGH"


HISTOGRAM = """num     #instances         #bytes  class name
----------------------------------------------
   1:         131000       5240000  [B
   2:          81000       3888000  java.lang.String
   3:          26500       2120000  java.util.HashMap$Entry
   4:            120          9600  java.lang.Class

Total       301200      151000000
"""


def test_histogram(spark):
    rows = lines(table(spark, a=HISTOGRAM), ["artifact_id"], "content")
    s = memory.histogram_summary(rows)
    r = s.first()
    assert (r["visible_entries"], r["total_instances"], r["total_bytes"], r["payload_like_bytes"], r["collection_like_bytes"], r["cache_like_bytes"], r["top_consumer"]) == (4, 301200, 151000000, 9128000, 2120000, 2120000, "[B")
    assert {x["finding_id"]: x["severity"] for x in assessment.assess("HEAP_HISTOGRAM", s).collect()} == {"histogram-cache-retention": "MEDIUM", "histogram-collection-retention": "MEDIUM", "histogram-payload-retention": "MEDIUM"}
    both = lines(table(spark, a=HISTOGRAM, b=HISTOGRAM.replace("5240000  [B", "9440000  [B")), ["artifact_id"], "content")
    pairs = spark.createDataFrame([(1, "a", "b")], "pair_id int, baseline_id string, current_id string")
    assert {x["finding_id"] for x in comparison.compare_histograms(pairs, memory.histogram_summary(both), memory.histogram(both)).collect()} == {"compare-heap-growth", "compare-heap-payload-growth"}


PMAP = """4711:   java -Xmx2g Main
Address           Kbytes     RSS   Dirty Mode  Mapping
0000000600000000   65536   12000   12000 rw---   [ anon ]
0000000604000000  262144       0       0 -----   [ anon ]
00007f1000000000    2048     900       0 r-x--  libc.so.6
---------------- ------- ------- -------
total kB          329728   12900   12000
"""


def test_pmap(spark):
    rows = lines(table(spark, a=PMAP, b="9001:   java\n00000006c0000000 300000K rw---   [ anon ]\n00000006d2500000 2500000K -----   [ anon ]\n total          2800000K\n"), ["artifact_id"], "content")
    s = {r["artifact_id"]: r for r in memory.pmap_summary(rows).collect()}
    assert (s["a"]["pid"], s["a"]["total_size_kb"], s["a"]["total_rss_kb"], s["a"]["anon_size_kb"], s["a"]["anon_rss_kb"], s["a"]["largest_resident_size_kb"], s["a"]["top_size_category"]) == (4711, 329728, 12900, 327680, 12000, 65536, "anon")
    assert (s["b"]["total_size_kb"], s["b"]["rss_available"], s["a"]["rss_available"]) == (2800000, False, True)
    found = {(r["artifact_id"], r["finding_id"], r["severity"]) for r in assessment.assess("PMAP", memory.pmap_summary(rows)).collect()}
    assert found == {("a", "pmap-anon-pressure", "HIGH"), ("a", "pmap-virtual-resident-mismatch", "MEDIUM"), ("b", "pmap-anon-pressure", "HIGH")}


NMT = """Total: reserved=4100000KB +8200KB, committed=150000KB -120000KB
-                 Java Heap (reserved=3600000KB, committed=30000KB -150000KB)
-                     Class (reserved=48000KB +1500KB, committed=26000KB +18500KB)
                            (classes #39000 +26000)
                           : (  Metadata)
                            (    reserved=65536KB, committed=18944KB +12800KB)
                            (    used=17000KB +11500KB)
                           : (  Class space)
                            (    reserved=49152KB, committed=24576KB +17000KB)
                            (    used=19800KB +13800KB)
-                    Thread (reserved=18000KB +900KB, committed=800KB +50KB)
                            (thread #0)
                            (stack: reserved=17900KB +896KB, committed=760KB +48KB)
"""


def test_nmt(spark):
    s = memory.nmt_summary(lines(table(spark, a=NMT), ["artifact_id"], "content"))
    r = s.first()
    assert (r["reserved_kb"], r["reserved_delta_kb"], r["committed_delta_kb"], r["class_committed_kb"], r["class_committed_delta_kb"], r["class_count"], r["class_count_delta"]) == (4100000, 8200, -120000, 26000, 18500, 39000, 26000)
    assert (r["metaspace_used_delta_kb"], r["class_space_used_kb"], r["class_space_used_delta_kb"], r["stack_reserved_kb"], r["snapshot_kind"]) == (11500, 19800, 13800, 17900, "diff")
    assert {x["finding_id"] for x in assessment.assess("NMT", s).collect()} == {"nmt-metaspace-pressure", "nmt-compressed-class-space-pressure", "nmt-class-metadata-growth"}


CGROUP = """[memory.current]
2040000000
[memory.max]
2147483648
[memory.high]
1900000000
[memory.events]
high 95
max 9
oom 3
oom_kill 2
[memory.stat]
anon 1500000000
[memory.pressure]
some avg10=7.25 avg60=5.00 avg300=2.00 total=61000
full avg10=1.50 avg60=0.75 avg300=0.25 total=9000
[cpu.max]
75000 100000
[cpuset.cpus.effective]
0-4,9
"""


def test_cgroup(spark):
    s = memory.cgroup_summary(lines(table(spark, a=CGROUP), ["artifact_id"], "content"))
    r = s.first()
    assert (r["current_bytes"], r["max_bytes"], r["high_bytes"], r["oom_events"], r["oom_kill_events"], r["quota_cores"], r["cpus"], r["cpu_ceiling_cores"], r["memory_some_avg10"]) == (2040000000, 2147483648, 1900000000, 3, 2, 0.75, 6, 0.75, 7.25)
    assert {x["finding_id"]: x["severity"] for x in assessment.assess("CONTAINER_MEMORY", s).collect()} == {"container-memory-limit-pressure": "CRITICAL", "container-memory-high-pressure": "HIGH", "container-memory-oom-events": "CRITICAL", "container-memory-reclaim-stalls": "HIGH", "container-cpu-quota-or-processor-mis-sizing": "MEDIUM"}


OOM = """Apr 12 07:15:40 worker-3 kernel: oom-kill: constraint=CONSTRAINT_MEMCG,oom_memcg=/pods/a1,task=java,pid=777,uid=0
Apr 12 07:15:40 worker-3 kernel: Memory cgroup out of memory: Killed process 777 (java) total-vm:3100000kB, anon-rss:990000kB, file-rss:10240kB, shmem-rss:0kB
"""
POD = """Name:           billing-0
Namespace:      ledger
Containers:
  billing:
    State:          Waiting
      Reason:       CrashLoopBackOff
    Last State:     Terminated
      Reason:       OOMKilled
      Exit Code:    137
      Finished:     Sun, 12 Apr 2026 07:15:40 -0700
    Restart Count:  6
Conditions:
  Type              Status
"""


def test_oom_signals(spark):
    rows = lines(table(spark, k=OOM, p=POD), ["artifact_id"], "content")
    killed = incidents.kernel_events(rows, 2026).where("killed").first()
    assert (killed["pid"], killed["process"], killed["total_vm_kb"], killed["anon_rss_kb"], str(killed["event_ts"])) == (777, "java", 3100000, 990000, "2026-04-12 07:15:40")
    pod = incidents.pods(rows).first()
    assert (pod["container"], pod["pod"], pod["state_reason"], pod["last_reason"], pod["exit_code"], pod["restart_count"]) == ("billing", "billing-0", "CrashLoopBackOff", "OOMKilled", 137, 6)
    found = {(r["artifact_id"], r["finding_id"], r["severity"]) for r in assessment.assess("OOM_SIGNAL", incidents.oom_summary(rows, 2026)).collect()}
    assert found == {("k", "oom-signal-kernel-oom-kill", "CRITICAL"), ("p", "oom-signal-pod-oomkilled", "CRITICAL"), ("p", "oom-signal-restart-loop", "CRITICAL")}


DUMP = """2026-05-01 18:00:00
Full thread dump OpenJDK 64-Bit Server VM (21+35 mixed mode):

"Keeper" #12 prio=5 cpu=300.50ms elapsed=40.00s tid=0x1 nid=0x1101 runnable [0x1]
   java.lang.Thread.State: RUNNABLE
    at org.sample.Ledger.post(Ledger.java:88)
    - locked <0x00000000aa550010> (a java.lang.Object)

"grpc-exec-3" #21 daemon prio=5 cpu=80.25ms elapsed=30.10s tid=0x2 nid=0x1102 waiting for monitor entry [0x2]
   java.lang.Thread.State: BLOCKED (on object monitor)
    at org.sample.Ledger.post(Ledger.java:88)
    - waiting to lock <0x00000000aa550010> (a java.lang.Object)

"grpc-exec-4" #22 daemon prio=5 cpu=75.75ms elapsed=30.05s tid=0x3 nid=0x1103 waiting for monitor entry [0x3]
   java.lang.Thread.State: BLOCKED (on object monitor)
    at org.sample.Ledger.post(Ledger.java:88)
    - waiting to lock <0x00000000aa550010> (a java.lang.Object)

Found one Java-level deadlock:
=============================
"Keeper":
  waiting to lock monitor 0x1 (object 0x2, a java.lang.Object),
  which is held by "Other"

Java stack information for the threads listed above:
===================================================
"Keeper":
    at org.sample.A.b(A.java:1)
"""


def test_thread_dump(spark):
    rows = lines(table(spark, a=DUMP), ["artifact_id"], "content")
    t = {r["name"]: r for r in threads.threads(rows).collect()}
    assert set(t) == {"Keeper", "grpc-exec-3", "grpc-exec-4"} and t["Keeper"]["deadlocked"] and t["grpc-exec-3"]["daemon"] and t["Keeper"]["cpu_ms"] == 300.5
    spot = threads.hotspots(threads.threads(rows)).first()
    assert (spot["waiters"], spot["blocked"], spot["owner"], spot["waiting_names"]) == (2, 2, "Keeper", ["grpc-exec-3", "grpc-exec-4"])
    found = {x["finding_id"]: x["severity"] for x in assessment.assess("THREAD_DUMP", threads.summary(rows)).collect()}
    assert found == {"thread-dump-java-deadlock": "CRITICAL", "thread-dump-lock-contention-hotspot": "MEDIUM", "thread-dump-stuck-thread-pool": "MEDIUM"}


CRASH = """#
# There is insufficient memory for the Java Runtime Environment to continue.
# Native memory allocation (mmap) failed to map 131072 bytes. Error detail: committing reserved memory.
# JRE version: OpenJDK Runtime Environment (17.0.5+8)
Current thread (0x00009a):  JavaThread "C2 CompilerThread1" daemon [_thread_in_native]
Time: Fri May  1 18:00:00 2026 UTC elapsed time: 33.250000 seconds (0d 0h 0m 33s)
"""


def test_crash_log(spark):
    s = incidents.crash_summary(table(spark, a=CRASH))
    r = s.first()
    assert (r["crash_type"], r["requested_bytes"], r["current_thread_name"], r["elapsed_s"]) == ("native_allocation_failure", 131072, "C2 CompilerThread1", 33.25)
    assert {x["finding_id"] for x in assessment.assess("HS_ERR_LOG", s).collect()} == {"hs-err-native-allocation-failure", "hs-err-compiler-thread-native-oom"}


def test_jfr(spark, tmp_path):
    rows = ['{"type":"jdk.JavaMonitorEnter","startTime":"2026-01-01T00:00:0%d.000Z","durationMs":300,"thread":"t%d","stack":[{"method":"a.B.c","java":true}]}' % (k, k) for k in range(3)]
    rows += ['{"type":"jdk.ObjectAllocationSample","startTime":"2026-01-01T00:00:05.000Z","className":"[B","bytes":4000000}'] * 5 + ["not json"]
    (tmp_path / "r.json").write_text("\n".join(rows))
    t = jfr.timeline(jfr.read(spark, f"file://{tmp_path}"))
    assert {r["signal_family"]: r["n"] for r in jfr.by_family(t).collect()} == {"lockContention": 3, "allocation": 5}
    state = jfr.failures(spark, f"file://{tmp_path}").first()
    assert (state["events"], state["unreadable"], state["status"]) == (8, 1, "PARTIAL")
    found = {x["finding_id"]: x["severity"] for x in assessment.assess("JFR", jfr.summary(t)).collect()}
    assert found["jfr-lock-contention-events"] == "MEDIUM" and found["jfr-allocation-churn"] == "HIGH" and found["jfr-dominant-allocation-class"] == "HIGH"


def test_classification_and_reading(spark, tmp_path):
    for name, text in {"gc.log": G1, "h.txt": HISTOGRAM, "p.txt": PMAP, "n.txt": NMT, "t.txt": DUMP, "c.txt": CRASH, "o.txt": OOM, "g.txt": CGROUP, "x.txt": "hello"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "cg").mkdir()
    for name, text in {"memory.current": "5", "memory.max": "10"}.items():
        (tmp_path / "cg" / name).write_text(text)
    found = artifacts.read_artifacts(spark, f"file://{tmp_path}")
    kinds = {r["name"]: r["type"] for r in found.collect()}
    assert kinds == {"gc.log": "GC_LOG", "h.txt": "HEAP_HISTOGRAM", "p.txt": "PMAP", "n.txt": "NMT", "t.txt": "THREAD_DUMP", "c.txt": "HS_ERR_LOG", "o.txt": "OOM_SIGNAL", "g.txt": "CONTAINER_MEMORY", "x.txt": "UNKNOWN", "memory.current": "UNKNOWN", "memory.max": "UNKNOWN"}
    grouped = artifacts.with_cgroup_groups(found)
    assert {r["name"]: r["content"] for r in grouped.where("type = 'CONTAINER_MEMORY'").collect()}["cg"] == "[memory.current]\n5\n[memory.max]\n10"
    assert artifacts.inventory(grouped).where("status = 'UNSUPPORTED'").count() == 1 and artifacts.kind_named("hs-err") == "HS_ERR_LOG"


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(1, 2001))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("x\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = artifacts.read_lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r["line_no"], r["line"]) for r in rows if r["artifact_id"].endswith("a.log")} == {(k, f"line {k}") for k in range(1, 2001)}
    assert [(r["line_no"], r["line"]) for r in rows if r["artifact_id"].endswith("b.log")] == [(1, "x"), (2, "y")]


def test_correlation_runs_in_order(spark):
    ids = ["gc-repeated-full-gcs", "pmap-anon-pressure", "container-memory-oom-events", "oom-signal-kernel-oom-kill", "hs-err-fatal-signal", "nmt-thread-stack-pressure"]
    findings = spark.createDataFrame([("i", x) for x in ids] + [("j", "gc-repeated-full-gcs")], "incident string, finding_id string")
    found = [(r["finding_id"], r["severity"]) for r in correlation.correlate_incident(findings, ["incident"]).orderBy("position").collect()]
    assert found == [("correlation-memory-pressure", "CRITICAL"), ("correlation-container-memory-pressure", "CRITICAL"), ("correlation-container-oom-escalation", "CRITICAL"), ("correlation-jvm-memory-escalated-to-oom", "CRITICAL"), ("correlation-native-pressure", "HIGH"), ("correlation-crash-under-memory-distress", "CRITICAL")]


def test_correlation_plan_grows_by_its_literals_only(spark):
    findings = spark.createDataFrame([("i", "a")], "incident string, finding_id string")
    size = lambda n: len(correlate(findings, ["incident"], [correlation.RULES[k % 22] for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert size(44) - size(22) < 1.5 * (size(22) - size(1))


def test_reports(spark, tmp_path):
    findings = spark.createDataFrame([("x", "a", "gc-heap-saturation", "HIGH"), ("x", "a", "gc-heap-saturation", "HIGH"), ("y", "b", "f", "LOW")], "incident string, artifact_id string, finding_id string, severity string")
    reports.save(reports.assemble(findings, "incident", "2026-01-01 00:00:00"), f"file://{tmp_path}/r")
    back = reports.load(spark, f"file://{tmp_path}/r")
    assert {r["analysis_id"]: (r["severity"], r["n_findings"]) for r in back.collect()} == {"x": ("HIGH", 2), "y": ("LOW", 1)}
    assert reports.catalog(back, "high", "gc-heap-saturation").count() == 1
    with pytest.raises(ValueError, match="analysis id"):
        reports.load(spark, "r", "../x")
    text = spark.createDataFrame([("see /var/log/app.log and /var/log/app.log at 10.0.0.1, DB_PASSWORD=hunter2 on db.example.io",), (None,)], "t string")
    assert [r["t"] for r in reports.shareable(text, "t").collect()] == ["see [redacted-path-1] and [redacted-path-1] at [redacted-host-1], DB_PASSWORD=[redacted-env-1] on [redacted-host-2]", None]


def test_redaction_is_stable_within_a_report(spark):
    rows = [
        ("a", 1, "java command: app --x=1 /etc/p"), ("a", 2, "LIMIT=5 API_KEY = k1, host web.example.io v1.2 java.util.HashMap run.sh a.b.c.sh"), ("a", 3, "/opt/x then web.example.io and C:\\dir\\f.txt; 10.1.2.3"), ("a", 4, None), ("a", 5, "plain"),
        ("b", 1, "at web.example.io /opt/x"), ("b", 2, "OCI_ID=7 gpt-4.1 model llama3.2"),
    ]
    df = spark.createDataFrame(rows, "report string, line_no int, text string")
    got = {(r["report"], r["line_no"]): r["text"] for r in reports.shareable(df, "text", ["report"]).collect()}
    assert got == {
        ("a", 1): "java command: [redacted-command-1]", ("a", 2): "LIMIT=5 API_KEY = [redacted-env-1], host [redacted-host-1] v1.2 java.util.HashMap run.sh [redacted-host-2]",
        ("a", 3): "[redacted-path-1] then [redacted-host-1] and [redacted-path-2]; [redacted-host-3]", ("a", 4): None, ("a", 5): "plain",
        ("b", 1): "at [redacted-host-1] [redacted-path-1]", ("b", 2): "OCI_ID=[redacted-env-1] gpt-4.1 model llama3.2",
    }


def test_selectors_and_budgets():
    s = Selector.parse("GCID=7, cause = Metadata; cause=G1\nstart=x,empty=")
    assert s.values == {"gcid": "7", "cause": "G1", "start": "x"} and s.number("gcId") == 7.0 and s.number("start") is None
    assert Selector.parse(" some text ").values == {"pattern": "some text"} and Selector.parse(None).values == {}
    session = Session("analyze")
    assert [session.allow("a", str(k), True) for k in range(9)] == [True] * 8 + [False]
    assert [session.allow("a", "c", False) for _ in range(5)] == [True] * 4 + [False] and len(session.calls) == 13


def test_selector_filter(spark):
    df = spark.createDataFrame([("G1 Pause", 1), ("Metadata", 2), (None, 3)], "cause string, n int")
    assert df.where(Selector.parse("cause=meta").matching({"cause": "cause"})).select(F.sum("n")).first()[0] == 2
