"""Block joins, ranges of incidents, streaks and windows, and what a budget shows, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from heapstone.operators import budget, ranges, retrieval
from heapstone.operators.budget import Budget
from heapstone.operators.context import Selector
from heapstone.parse import gc
from heapstone.views import gc_ranges


@pytest.mark.parametrize("block", [1, 7, 64])
def test_points_in_ranges_as_a_plain_loop_finds_them(spark, block):
    rng = random.Random(block)
    spans = [(a, lo, lo + rng.choice([0, 3, 200])) for a in "xy" for lo in rng.sample(range(-5, 400), 25)]
    points = [(a, n) for a in "xyz" for n in rng.sample(range(420), 150)]
    found = ranges.points_in(spark.createDataFrame(spans, "artifact_id string, first_line int, last_line int"), spark.createDataFrame(points, "artifact_id string, line_no int"), block=block)
    assert sorted((r["artifact_id"], r["first_line"], r["last_line"], r["line_no"]) for r in found.collect()) == sorted((a, lo, hi, n) for a, lo, hi in spans for b, n in points if a == b and lo <= n <= hi)


def test_the_join_is_by_block_not_by_artifact(spark):
    lines = spark.range(2_000_000).selectExpr("'a' AS artifact_id", "CAST(id AS INT) AS line_no", "'x' AS line")
    spans = spark.range(20_000).selectExpr("'a' AS artifact_id", "CAST(id * 100 AS INT) AS first_line", "CAST(id * 100 + 9 AS INT) AS last_line")
    assert ranges.points_in(spans, lines).count() == 200_000  # by artifact alone, 40 billion pairs
    plan = ranges.points_in(spans, lines)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbered_text(spark):
    lines = spark.createDataFrame([("a", n, f"l{n}") for n in range(1, 6)], "artifact_id string, line_no int, line string")
    spans = spark.createDataFrame([("a", 2, 3), ("a", 2, 3), ("a", 9, 12)], "artifact_id string, first_line int, last_line int")
    assert [r["text"] for r in ranges.numbered_text(spans, lines).collect()] == ["     2 | l2\n     3 | l3"]


#: A log whose lines are numbered one by one; collections 3, 4 and 5 fail, 9 is long.
LOG = ["[0.000s][info][gc] Using G1"]
for k in range(1, 160):
    at = f"[{k / 2:.3f}s][info][gc"
    if k in (3, 4, 5):
        LOG += [f"{at},start] GC({k}) Pause Full (G1 Compaction Pause)", f"{at}] GC({k}) To-space exhausted", f"{at}] GC({k}) Pause Full (G1 Compaction Pause) 900M->{800 + k}M(1024M) 20.0ms"]
    elif k == 120:
        LOG += [f"{at}] GC({k}) Pause Full (G1 Compaction Pause) 700M->100M(1024M) 950.0ms"]
    else:
        LOG += [f"{at}] GC({k}) Pause Young (Normal) (G1 Evacuation Pause) 300M->100M(1024M) {k}.0ms"]


@pytest.fixture(scope="module")
def log(spark):
    lines = spark.createDataFrame([("g", n, line) for n, line in enumerate(LOG, 1)], "artifact_id string, line_no int, line string").cache()
    return lines, gc.events(lines).cache(), spark.createDataFrame([("g", "G1")], "artifact_id string, collector string")


def lines_of(text):
    return [n for n, line in enumerate(LOG, 1) if text in line]


def test_incidents_are_ranges_of_lines(log):
    lines, events, collectors = log
    found = {r["slice_id"]: (r["first_line"], r["last_line"]) for r in gc_ranges.incident_slices(events, lines, collectors).collect()}
    failing = [n for k in (3, 4, 5) for n in lines_of(f"GC({k}) ")]
    assert found["gc-incident-dominant-g1-distress-window"] == (1, max(failing) + 5)
    assert found["gc-incident-longest-full-gc"] == (lines_of("950.0ms")[0] - 5, lines_of("950.0ms")[0] + 5)
    assert found["gc-incident-first-to-space-distress"] == (1, lines_of("To-space")[0] + 5)
    assert found["gc-incident-densest-failure-region"] == (min(lines_of("To-space")) - 3, max(failing) + 3)
    assert found["gc-incident-tail"] == (len(LOG) - 23, len(LOG))
    assert found["gc-incident-peak-occupancy"] == (lines_of("805M")[0] - 5, lines_of("805M")[0] + 5)
    assert "gc-incident-first-full-gc" not in found and "gc-incident-longest-allocation-stall" not in found
    pick = lambda name: [(r["slice_id"], r["n"]) for r in gc_ranges.incident(events, lines, collectors, name).collect()]
    assert pick("Dominant Pressure")[0][0] == "gc-incident-dominant-g1-distress-window" and pick("stall")[0][0] == "gc-incident-dominant-g1-distress-window"
    assert pick("failure") == [("gc-incident-densest-failure-region", 6)] and pick("gc-incident-tail")[0][0] == "gc-incident-tail" and pick("nonsense") == [] and pick("humongous") == []


def test_an_event_is_widened_to_the_lines_of_its_number(log):
    lines, events, _ = log
    one = gc_ranges.event_ranges(events.where("kind = 'pause' AND gc_id = 4"), lines, gc_ranges.Around(0, 0, 24, 1)).first()
    assert (one["first_line"], one["last_line"]) == (min(lines_of("GC(4) ")) - 1, max(lines_of("GC(4) ")) + 1)
    assert gc_ranges.event_ranges(events.where("false"), lines).count() == 0


def test_streaks_windows_and_their_events(log):
    lines, events, collectors = log
    found = gc_ranges.streak(events, lines, "full gc").orderBy("position").collect()
    heavy, late = lines_of("950.0ms")[0], lines_of("805M")[0]
    assert [r["line_no"] for r in found] in ([heavy, lines_of("803M")[0]], [lines_of("805M")[0], lines_of("803M")[0]]) and late
    assert gc_ranges.streak(events, lines, "unknown").count() == 0
    window = gc_ranges.time_window(events, lines, Selector.parse("start=10; end=12")).first()
    inside = [n for n, line in enumerate(LOG, 1) if any(f"[{s}.{h}00s]" in line for s, h in ((10, 0), (10, 5), (11, 0), (11, 5), (12, 0)))]
    assert (window["first_line"], window["last_line"], window["n"]) == (min(inside) - 2, max(inside) + 17, 5)
    assert gc_ranges.events_of(gc_ranges.incident(events, lines, collectors, "tail"), events).count() == 24


def test_retrieval_of_requests(log, spark):
    lines, events, collectors = log
    empty = retrieval.index(lines, lines.where("false"))
    get = lambda text: (lambda f: (f[0], f[1].count()))(retrieval.retrieve(lines, empty, events, Selector.parse(text), collectors=collectors))
    assert get("incident=tail") == ("incident", 1) and get("streak=distress")[0] == "streak" and get("gcId=40, windowSeconds=4") == ("window", 1)
    assert get("lines=abc") == ("lines", 0) and get("lines=9-4") == ("lines", 1) and get("incident=what") == ("incident", 0)


def test_budgets_by_window():
    assert Budget.of_window(None) == Budget.of_window(8192) == Budget(12, 12, 12, 2800, 2200) and Budget.of_window(70_000).raw_chars == 7600
    assert Budget.of_window(20_000, compact=True) == Budget(8, 8, 8, 1800, 1200) and Budget.of_window(-5) == Budget.of_window(None)
    assert Budget.of_window(8192).widened() == Budget(24, 28, 24, 16_000, 16_000)


def test_slices_chosen_under_a_budget(spark):
    rng = random.Random(2)
    slices = [(a, f"s{n}", kind, n, rng.randint(0, 900)) for a in ("a", "b") for kind in ("structured", "raw", "other") for n in range(20)]
    frame = spark.createDataFrame(slices, "artifact_id string, slice_id string, kind string, ordinal int, chars int")
    b = Budget(2, 5, 6, 400, 300, total_chars=1500, reserved=2)
    want = set()
    for a in ("a", "b"):
        held, rest = [], []
        for kind, most, each in (("structured", 5, 400), ("raw", 6, 300)):
            own = [s for s in slices if s[0] == a and s[2] == kind][:most]
            held += [(s, min(s[4], each)) for s in own[:2]]
            rest += [(s, min(s[4], each)) for s in own[2:]]
        total = 0
        for n, (s, size) in enumerate(held + rest):
            total += size
            if n < len(held) or total <= 1500:
                want.add((a, s[1], s[2], size))
    chosen = budget.choose(frame, b)
    assert chosen.count() == len(slices)
    assert {(r["artifact_id"], r["slice_id"], r["kind"], r["shown_chars"]) for r in chosen.where("chosen").collect()} == want
    told = {r["artifact_id"]: r for r in budget.coverage(chosen).collect()}
    assert told["a"]["shown"] == sum(w[0] == "a" for w in want) and told["a"]["more"] and told["a"]["omitted_raw"] == 20 - sum(w[0] == "a" and w[2] == "raw" for w in want)
    assert budget.choose(frame.where("false"), b).count() == 0


def test_small_artifacts_are_shown_whole(spark):
    slices = spark.createDataFrame([(a, f"s{n}", "raw", n, 5000) for a in ("dump", "large", "map") for n in range(20)], "artifact_id string, slice_id string, kind string, ordinal int, chars int")
    artifacts = spark.createDataFrame([("dump", "THREAD_DUMP", 9000, 100), ("large", "GC_LOG", 99_000, 100), ("map", "PMAP", 900, 10), ("none", "GC_LOG", 0, 0)], "artifact_id string, type string, chars int, n_lines int")
    whole = budget.small(slices, artifacts)
    assert {r["artifact_id"]: r["whole"] for r in whole.collect()} == {"dump": True, "large": False, "map": False, "none": False}
    counts = {r["artifact_id"]: (r["n"], r["t"]) for r in budget.choose(slices, Budget.of_window(), whole).where("chosen").groupBy("artifact_id").agg(F.count("*").alias("n"), F.count_if("truncated").alias("t")).collect()}
    assert counts == {"dump": (20, 0), "large": (12, 12), "map": (12, 12)}
