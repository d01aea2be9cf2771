"""Views, retrieval, alignments and ordering on small inputs: dispatch, nulls, ties, empty tables, results by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heapstone.operators import compare, ordered, ranking, retrieval, timeline
from heapstone.operators.context import Selector, lines
from heapstone.parse import gc
from heapstone.rulebook import alignment, correlation
from heapstone.sources import ordering
from heapstone.views import compute
from heapstone.views import gc as views

LOG = """[0.100s][info][gc] Using G1
[1.000s][info][gc] GC(1) Pause Young (Normal) (G1 Evacuation Pause) 900M->700M(1024M) 25.000ms
[5.500s][info][gc] GC(2) To-space exhausted
[6.000s][info][gc] GC(2) Pause Full (G1 Compaction Pause) 1023M->1010M(1024M) 1200.000ms
[7.000s][info][gc] GC(3) Pause Full (Metadata GC Threshold) 1022M->800M(1024M) 90.000ms
[60.000s][info][gc,phases] GC(4) Concurrent Mark 40.000ms
"""


@pytest.fixture(scope="module")
def source(spark):
    rows = spark.createDataFrame([("a", LOG), ("empty", "nothing here")], "artifact_id string, content string")
    return compute.Source(lines=lines(rows, ["artifact_id"], "content"), artifacts=rows)


@pytest.mark.parametrize(
    ("request_text", "view"),
    [
        ("incident=peak", "gc-incident"), ("dominant-window please", "gc-incident"), ("streak=full-gc", "gc-streak"), ("start=1;end=5", "gc-time-window-summary"), ("cause=metadata", "gc-pause-focus"), ("phaseKind=concurrent", "gc-phase-focus"), ("signalType=TO_SPACE", "gc-signal-focus"), ("gcId=2", "gc-id-focus"), ("g1-pressure", "gc-collector-pressure-summary"),
        ("what cause dominates", "gc-cause-distribution"), ("headroom", "gc-recovery-summary"), ("mixed-phase", "g1-cycle-progression-summary"), ("metaspace use", "gc-metaspace-summary"), ("evacuation trouble", "gc-failure-summary"), ("concurrent work", "gc-phase-summary"), ("cpu time", "gc-cpu-summary"), ("occupancy", "gc-occupancy-progression"), ("", "gc-pause-percentiles"), (None, "gc-pause-percentiles"),
    ],
)
def test_requests_choose_views_in_order(request_text, view):
    assert compute.choose("GC_LOG", request_text)[0].id == view


def test_every_kind_has_a_default_view():
    assert all(compute.choose(kind, "?")[0] is book[-1] and book[-1].triggers == ("",) for kind, book in compute.VIEWS.items())


def test_windows_streaks_and_incidents(source):
    name, window = compute.compute("GC_LOG", source, "start=to-space; windowSeconds=2")
    row = window.first()
    assert name == "gc-time-window-summary" and (row["start_s"], row["end_s"], row["pause_count"], row["full_gc_count"], row["signal_count"]) == (5.5, 7.5, 2, 2, 1)
    assert row["p95_pause_ms"] == 1200.0 and row["overhead_pct"] == pytest.approx(64.5)
    streaks = {r["streak"]: (r["n"], r["first_line"], r["last_line"]) for r in compute.compute("GC_LOG", source, "streak")[1].collect()}
    assert streaks == {"full-gc": (2, 4, 5), "failure-signal": (1, 3, 3), "distress": (3, 3, 5)}
    found = {k: compute.compute("GC_LOG", source, f"incident={k}")[1].first() for k in ("dominant", "full-gc", "peak", "tail", "unknown")}
    assert (found["dominant"]["n"], found["dominant"]["lo"], found["dominant"]["hi"]) == (3, 5.0, 7.5) and found["unknown"]["incident"] == "dominant-pressure"
    assert (found["full-gc"]["lo"], found["full-gc"]["hi"]) == (pytest.approx(4.8), pytest.approx(7.2)) and found["peak"]["first_line"] == 4 and found["tail"]["n"] == 5
    assert compute.compute("GC_LOG", source, "gcId=2")[1].count() == 2 and compute.compute("GC_LOG", source, "start=9000;end=9001")[1].first()["pause_count"] == 0


def test_views_of_no_events(spark, source):
    none = gc.events(source.lines.where("false"))
    assert views.streaks(none).count() == views.pause_percentiles(none).count() == views.failure_summary(none).count() == 0


def test_retrieval_in_order_of_selectors(spark, source):
    events = gc.events(source.lines)
    index = retrieval.index(source.lines, events.where("kind = 'signal'").select("artifact_id", "line_no"), F.when(F.col("line").contains("Full"), F.col("line")))
    get = lambda text, seen=None: (lambda found: (found[0], sorted((r["artifact_id"], r["first_line"], r["last_line"]) for r in found[1].collect())))(retrieval.retrieve(source.lines, index, events, Selector.parse(text), seen))
    assert get("slice=RAW-chunk-001") == ("slice", [("a", 1, 7), ("empty", 1, 1)]) and get("lines=5-3") == ("lines", [("a", 3, 5)])
    assert get("cause=metadata") == ("events", [("a", 3, 7)]) and get("gcId=2") == ("gc-id", [("a", 1, 6)]) and get("start=exhausted;end=Metadata") == ("time", [("a", 3, 5)])
    assert get("pattern=concurrent mark") == ("pattern", [("a", 4, 7)]) and get("section=compaction") == ("section", [("a", 4, 4)])
    seen = index.where("ordinal = 1").select("artifact_id", "slice_id")
    assert get("") == ("next", [("a", 1, 7), ("empty", 1, 1)]) and get("", seen)[1] == [("a", 4, 4)]


def test_ranges_merge_and_texts_follow(spark):
    ranges = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 4, 6), ("a", 9, 9), ("b", 1, 1)], "artifact_id string, first_line int, last_line int")
    merged = retrieval.merged(ranges)
    assert sorted((r["artifact_id"], r["first_line"], r["last_line"], r["n"]) for r in merged.collect()) == [("a", 1, 6, 3), ("a", 9, 9, 1), ("b", 1, 1, 1)]
    rows = lines(spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6\n7"), ("b", None)], "artifact_id string, t string"), ["artifact_id"], "t")
    assert [(r["first_line"], r["text"]) for r in retrieval.text_of(merged, rows).collect()] == [(1, "1\n2\n3\n4\n5\n6")]
    assert sorted(r["line_no"] for r in retrieval.anchors(rows).collect()) == [1, 3, 4, 6, 7]


def test_order_of_snapshots(spark):
    rows = [("g", 1, None, "heap-after.txt", 5), ("g", 2, None, "heap-before.txt", 4), ("h", 1, None, "a_20240102_030405.txt", 9), ("h", 2, None, "a-2024-01-01.txt", 9), ("i", 1, 7, "x", None), ("i", 2, 3, "x", None), ("j", 1, None, "x", None), ("j", 2, 1, "x", None)]
    df = spark.createDataFrame(rows, "g string, k int, captured_us long, name string, modified_us long")
    got = {(r["g"], r["k"]): (r["basis"], r["position"]) for r in ordering.ordered(df, ["g"], "k", pairs=True).collect()}
    assert got == {("g", 1): ("filename-role", 2), ("g", 2): ("filename-role", 1), ("h", 1): ("filename-time", 2), ("h", 2): ("filename-time", 1), ("i", 1): ("capture-time", 2), ("i", 2): ("capture-time", 1), ("j", 1): ("input", 1), ("j", 2): ("input", 2)}
    assert ordering.ordered(df, ["g"], "k").where("g = 'g'").first()["basis"] == "modified-time"
    dump = lines(spark.createDataFrame([("a", "\n2026-03-30 09:42:11\nFull thread dump"), ("b", "Capture time: 2026-03-30 09:42:12\n"), ("c", "none")], "artifact_id string, t string"), ["artifact_id"], "t")
    assert {r["artifact_id"]: r["captured_us"] % 100_000_000 for r in ordering.capture_time(dump).collect()} == {"a": 31_000_000, "b": 32_000_000}


def test_alignments_need_signals_and_clocks(spark):
    rows = [(1, ["lock-contention"], ["lock-contention"], "ABSOLUTE_NO_OVERLAP", ["t1"], ["t1", "t2"]), (2, ["lock-contention"], None, None, None, None), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "incident int, jfr_families array<string>, dump_families array<string>, t_dump string, jfr_threads array<string>, dump_threads array<string>")
    found = alignment.alignments(df, ["incident"])
    assert [tuple(r) for r in found.collect()] == [(1, "jfr-thread-dump-contention-alignment", 78, 1)]
    ids = {(r["incident"], r["finding_id"]) for r in alignment.as_findings(found, df, ["incident"]).collect()}
    assert ids == {(1, "align:jfr-thread-dump-contention"), (1, "apart:jfr-thread-dump")}
    needed = {x for rule in correlation.RULES for group in (*rule.needs, rule.blocked) for x in group if x.startswith("align:")}
    assert needed <= {"align:" + name.removesuffix("-alignment") for name, _, _ in alignment.ALIGNMENTS}


def test_no_shared_clock_is_no_alignment(spark):
    windows = spark.createDataFrame([(1, "a", 0, 10), (1, "b", None, None), (2, "a", 0, 10), (2, "b", 12, 13), (3, "a", 0, 1), (3, "b", 500, 501)], "i int, kind string, start_us long, end_us long")
    assert {(r["i"], r["finding_id"]) for r in correlation.aligned(windows, ["i"], "x", "a", "b", 5).collect()} == {(2, "align:x"), (3, "apart:x")}


def test_ordered_operators_on_nulls_and_ties(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, None), ("k", 4, 9.0), (None, 5, 1.0)], "k string, i int, v double")
    ranks = {r["k"]: (r["half"], r["all"]) for r in ordered.nearest_rank(df, ["k"], "v", {"half": 0.5, "all": 1.0}).collect()}
    assert ranks["k"] == (5.0, 9.0)
    tie = ranking.dominant(df.where("k = 'k' AND v IS NOT NULL").withColumn("c", F.col("v").cast("string")), ["k"], "c", F.lit(1).cast("long"), "i").first()
    assert (tie["c"], tie["amount"]) == ("5.0", 2)
    assert {r["k"]: r["streak"] for r in timeline.longest_streak(df, ["k"], ["i"], F.col("v") >= 5).collect()} == {"k": 2, None: 0}
    assert timeline.longest_streak(df.where("false"), ["k"], ["i"], F.col("v") >= 5).count() == 0
    left, right = spark.createDataFrame([(1, 10, 1), (1, 50, 2)], "k int, t long, l long"), spark.createDataFrame([(1, 8, 7), (1, 12, 5), (1, 12, 4), (2, 10, 9)], "k int, t long, r long")
    assert [tuple(r) for r in timeline.nearest_gap(left, right, ["k"], "t", "t", "l", "r", 5).collect()] == [(1, 1, 4, 2)]
    change = compare.keyed_delta(spark.createDataFrame([(1, 5)], "k int, m long"), spark.createDataFrame([(2, 3)], "k int, m long"), ["k"], ["m"], outer=True)
    assert sorted((r["k"], r["delta_m"]) for r in change.collect()) == [(1, 5), (2, -3)]
