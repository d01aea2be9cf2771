"""Digests that comparisons and sequences are told from: both sides of the measures, their changes, and the pairs of what is dominant on each side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heapstone.operators.compare import keyed_delta, pairwise, regression_score
from heapstone.parse import gc, jfr
from heapstone.rulebook.comparison import side_by_side

#: Measures of a GC log and of a recording that digests show.
GC_MEASURES = ("pause_count", "full_gc_count", "p95_pause_ms", "max_pause_ms", "total_pause_ms", "stop_the_world_pct", "peak_occupancy_ratio", "peak_post_gc_occupancy_ratio", "near_capacity_count", "allocation_stall_count", "failure_signal_count", "concurrent_phase_count", "longest_concurrent_phase_ms", "metaspace_full_gc_count", "low_reclaim_full_count", "average_reclaimed_mb")
GC_NAMES = ("collector", "dominant_cause_by_count", "dominant_cause_by_total_ms")
JFR_MEASURES = tuple(f"{name}_{m}" for name in jfr.SHORT.values() for m in ("count", "total_ms", "max_ms", "bytes"))
JFR_NAMES = ("execution_method", "runtime_method", "allocation_class", "old_object_class")
#: Families of each digest of a recording's changes.
RUNTIME, ALLOCATION, RETENTION = ("lockContention", "gcPause", "monitorWait", "threadPark", "ioLatency", "safepointPause"), ("allocation",), ("oldObject",)


def gc_digest(summary: DataFrame) -> DataFrame:
    """What one log is told by."""
    return summary.select("artifact_id", *GC_NAMES, *GC_MEASURES)


def jfr_digest(summary: DataFrame) -> DataFrame:
    """What one recording is told by."""
    return summary.select("artifact_id", *JFR_NAMES, *JFR_MEASURES, "start_us", "end_us")


def changes(pairs: DataFrame, digest: DataFrame, measures: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """pair_id, and for each measure baseline_, current_ and delta_ columns; for each name both sides and whether it changed."""
    wide = side_by_side(pairs, digest.select("artifact_id", *names, *measures))
    side = lambda p, m: F.coalesce(F.col(f"{p}_{m}"), F.lit(0))
    numbers = [c for m in measures for c in (side("b", m).alias(f"baseline_{m}"), side("c", m).alias(f"current_{m}"), (side("c", m) - side("b", m)).alias(f"delta_{m}"))]
    texts = [c for n in names for c in (F.col(f"b_{n}").alias(f"baseline_{n}"), F.col(f"c_{n}").alias(f"current_{n}"), (~F.col(f"b_{n}").eqNullSafe(F.col(f"c_{n}"))).alias(f"{n}_changed"))]
    return wide.select("pair_id", *texts, *numbers)


def gc_changes(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Two GC logs side by side; dominant causes tell a shift of what collections were for."""
    return changes(pairs, summary, GC_MEASURES, GC_NAMES)


def jfr_changes(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Two recordings side by side."""
    return changes(pairs, summary, JFR_MEASURES, JFR_NAMES)


def _sides(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the current and of the baseline artifact of each pair."""
    current = pairs.select("pair_id", F.col("current_id").alias("artifact_id")).join(rows, "artifact_id")
    return current, pairs.select("pair_id", F.col("baseline_id").alias("artifact_id")).join(rows, "artifact_id")


def cause_mix(pairs: DataFrame, pauses: DataFrame) -> DataFrame:
    """pair_id, cause and counts and times of both sides with their changes; causes of either side."""
    rows = gc.breakdown(pauses, "cause").withColumn("total_us", F.round(F.col("total_ms") * 1000).cast("long"))
    return keyed_delta(*_sides(pairs, rows), ["pair_id", "cause"], ["n", "total_us"], outer=True)


def trend(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """pair_id, key (a family, a thread, a method), and its counts, times, bytes and score on both sides: how much more of it the current recording shows.

    Rates are by the minute of each recording, shares of its recorded time in percent.
    """
    length = rows.groupBy("artifact_id").agg((F.greatest(F.lit(1.0), (F.max("end_us") - F.min("start_us")) / 1000.0)).alias("_ms"))
    sums = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy("artifact_id", key).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.sum("size_bytes").alias("bytes"))
    rated = sums.join(length, "artifact_id").select("artifact_id", F.col(key).alias("key"), "n", "total_ms", "bytes", (F.col("n") * 60000 / F.col("_ms")).alias("rate"), (100 * F.col("total_ms") / F.col("_ms")).alias("share"), (F.col("bytes") * 1000 / F.col("_ms")).alias("bps"))
    d = keyed_delta(*_sides(pairs, rated), ["pair_id", "key"], ["n", "total_ms", "bytes", "rate", "share", "bps"], outer=True)
    return d.withColumn("score", F.round(regression_score(F.col("delta_rate"), F.col("delta_share"), F.col("delta_bps")), 6))


def family_deltas(pairs: DataFrame, rows: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """The changes of some families: runtime pressure, allocation or retention."""
    return trend(pairs, rows.where(F.col("signal_family").isin(*families)), "signal_family").select("pair_id", "key", *(f"{side}_{m}" for m in ("n", "total_ms", "bytes") for side in ("baseline", "current", "delta")))


def dominant_incidents(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """pair_id, focus and score of each side's first incident window, whether the focus is the same, and the change of its score and size."""
    first = windows.where("rank = 1").select("artifact_id", "focus", "score_micro", "n")
    current, baseline = _sides(pairs, first)
    side = lambda df, p: df.select("pair_id", *(F.col(c).alias(f"{p}_{c}") for c in ("focus", "score_micro", "n")))
    both = side(current, "current").join(side(baseline, "baseline"), "pair_id", "full_outer")
    return both.withColumn("same_focus", F.coalesce(F.col("current_focus") == F.col("baseline_focus"), F.lit(False))).withColumn("delta_score_micro", F.coalesce("current_score_micro", F.lit(0)) - F.coalesce("baseline_score_micro", F.lit(0)))


def dominant_hotspots(pairs: DataFrame, rows: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """pair_id and the method most often on top of a family's stacks on each side (ties: by name), with its share."""
    spots = jfr.hotspots(rows, list(families))
    place = Window.partitionBy("artifact_id").orderBy(F.desc("n"), "top_method")
    best = spots.withColumn("_r", F.row_number().over(place)).where("_r = 1").select("artifact_id", "top_method", "n", "share")
    current, baseline = _sides(pairs, best)
    side = lambda df, p: df.select("pair_id", *(F.col(c).alias(f"{p}_{c}") for c in ("top_method", "n", "share")))
    return side(current, "current").join(side(baseline, "baseline"), "pair_id", "full_outer").withColumn("shifted", ~F.col("current_top_method").eqNullSafe(F.col("baseline_top_method")))


def sequence_summary(summaries: DataFrame, keys: list[str], order: str, measures: list[str]) -> DataFrame:
    """Each snapshot's change from the one before and from the first."""
    return pairwise(summaries, keys, order, measures)


def overall_window(events: DataFrame, start_us: DataFrame) -> DataFrame:
    """artifact_id, start_us, end_us of a log's timed events, lengths included, on the wall clock of its process (artifact_id, jvm_start_us)."""
    timed = events.where(F.col("elapsed_s").isNotNull()).groupBy("artifact_id").agg(F.min("elapsed_s").alias("lo"), F.max(F.col("elapsed_s") + F.coalesce("amount_ms", F.lit(0.0)) / 1000).alias("hi"))
    return _anchored(timed, start_us)


def distress_window(streaks: DataFrame, start_us: DataFrame) -> DataFrame:
    """The same of a log's densest distress, from its best cluster."""
    return _anchored(streaks.where("streak = 'distress'").select("artifact_id", F.col("start_s").alias("lo"), F.col("end_s").alias("hi")), start_us)


def _anchored(spans: DataFrame, start_us: DataFrame) -> DataFrame:
    at = lambda c: (F.col("jvm_start_us") + F.round(F.col(c) * 1_000_000)).cast("long")
    return spans.join(start_us, "artifact_id").select("artifact_id", at("lo").alias("start_us"), at("hi").alias("end_us"))

