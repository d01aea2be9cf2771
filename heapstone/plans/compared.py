"""Queries of rule books whose SQL states the rules by itself: comparisons of maps and thread dumps, assessment of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.parse import jfr, memory, threads
from heapstone.plans import rendered as r
from heapstone.plans.base import query, table
from heapstone.plans.parsed import _DUR, _HOTSPOTS, _JFR, _PMAP, _PMAP_COLUMNS
from heapstone.rulebook import assessment, comparison
from heapstone.sources import facts
from heapstone.sources.stored import stored


def _rules(table_name: str, key: str, rules: tuple[tuple[str, str, str], ...]) -> str:
    """One row for each rule that holds: id, condition, severity as SQL."""
    return " UNION ALL ".join(f"SELECT {key}, '{name}' AS finding_id, {severity} AS severity FROM {table_name} WHERE {condition}" for name, condition, severity in rules)


def _when(high: str, otherwise: str = "MEDIUM", severity: str = "HIGH") -> str:
    return f"CASE WHEN {high} THEN '{severity}' ELSE '{otherwise}' END"


_PMAP_RULES = (
    ("compare-pmap-growth", "CASE WHEN b_rss AND c_rss THEN c_total_rss - b_total_rss >= 8000 OR c_anon_rss - b_anon_rss >= 8000 ELSE c_total - b_total > 5000 OR c_anon - b_anon > 5000 END", "'HIGH'"),
    ("compare-pmap-reserved-expansion", "b_rss AND c_rss AND (c_total - b_total >= 32000 OR c_anon - b_anon >= 32000)", "'MEDIUM'"),
)


@query(f"""WITH {_PMAP}, k AS (SELECT substr(artifact_id, 3)::INT AS p, rss_available AS rss, total_rss_kb AS total_rss, anon_rss_kb AS anon_rss, total_size_kb AS total, anon_size_kb AS anon FROM s),
 w AS (SELECT b.p AS pair_id, b.rss AS b_rss, c.rss AS c_rss, b.total_rss AS b_total_rss, c.total_rss AS c_total_rss, b.anon_rss AS b_anon_rss, c.anon_rss AS c_anon_rss, b.total AS b_total, c.total AS c_total, b.anon AS b_anon, c.anon AS c_anon FROM k b JOIN k c ON c.p = b.p + 2) {_rules("w", "pair_id", _PMAP_RULES)}""")
def pmap_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each process map against the one after the next, of the same format."""
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    pairs = sizes.join(sizes.select((F.col("p_size") - 2).alias("p_size")), "p_size", "left_semi").select(F.col("p_size").alias("pair_id"), F.concat(F.lit("m-"), "p_size").alias("baseline_id"), F.concat(F.lit("m-"), F.col("p_size") + 2).alias("current_id"))
    return comparison.compare("PMAP", pairs, memory.pmap_summary(r.pmap_lines(spark, sf_dir))).select("pair_id", "finding_id", "severity")


def _stuck(p: str) -> str:
    return f"({p}.blocked >= 2 OR ({p}.threads >= 3 AND {p}.runnable = 0 AND {p}.stalled >= 2))"


_DUMPS = f"""{_HOTSPOTS}, pools AS (SELECT substr(artifact_id, 3)::BIGINT AS k, pool_name, count(*) AS threads, count(*) FILTER (state = 'RUNNABLE') AS runnable, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state = 'BLOCKED' OR (state IN ('WAITING', 'TIMED_WAITING') AND NOT idle)) AS stalled FROM t GROUP BY 1, 2),
 locks AS (SELECT substr(artifact_id, 3)::BIGINT AS k, monitor, waiters FROM waits),
 pool AS (SELECT c.k - 1 AS pair_id, c.pool_name, c.blocked, c.stalled, c.threads, c.runnable, coalesce(b.stalled, 0) AS was FROM pools c JOIN (SELECT DISTINCT k FROM pools) o ON o.k = c.k - 1 LEFT JOIN pools b ON b.k = c.k - 1 AND b.pool_name = c.pool_name
  WHERE {_stuck("c")} AND (b.k IS NULL OR NOT {_stuck("b")} OR c.stalled >= b.stalled + 2 OR c.blocked >= b.blocked + 2 OR (b.runnable > 0 AND c.runnable = 0 AND c.stalled > b.stalled))),
 lock AS (SELECT c.k - 1 AS pair_id, c.monitor, c.waiters, coalesce(b.waiters, 0) AS was, b.k IS NOT NULL AS known FROM locks c JOIN (SELECT DISTINCT k FROM pools) o ON o.k = c.k - 1 LEFT JOIN locks b ON b.k = c.k - 1 AND b.monitor = c.monitor WHERE c.waiters >= 2 AND (b.k IS NULL OR c.waiters >= b.waiters + 1)),
 best_pool AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY stalled - was DESC, blocked DESC, pool_name) = 1),
 best_lock AS (SELECT * FROM lock QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY waiters - was DESC, waiters DESC, monitor) = 1),
 s AS (SELECT substr(artifact_id, 3)::BIGINT AS k, count(*) AS n, count(*) FILTER (state = 'BLOCKED') AS b FROM t GROUP BY 1),
 w AS (SELECT b.k AS pair_id, c.n AS n, b.b AS b, c.b AS c FROM s b JOIN s c ON c.k = b.k + 1)"""


@query(f"""WITH {_DUMPS} SELECT pair_id, 'compare-thread-dump-contention-hotspot' AS finding_id, {_when("waiters >= 3")} AS severity FROM best_lock UNION ALL SELECT pair_id, 'compare-thread-dump-pool-stall', {_when("blocked >= 3 OR stalled >= 4")} FROM best_pool
 UNION ALL SELECT pair_id, 'compare-thread-dump-blocked-growth', {_when("c >= 8")} FROM w WHERE c - b >= 3 AND (c >= 8 OR (c >= 4 AND 5 * c >= n))""")
def thread_dump_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's thread dump against the next one's; all threads that wait for a monitor are blocked in these."""
    rows, pairs = _dumps(spark, sf_dir)
    return comparison.compare_dumps(pairs, stored(threads.summary(r.dump_lines(spark, sf_dir), rows), "summaries"), threads.hotspots(rows), threads.pools(rows)).select("pair_id", "finding_id", "severity")


@query(f"WITH {_DUMPS} SELECT pair_id, monitor, known, was AS b_waiters, waiters AS c_waiters FROM lock")
def thread_dump_monitor_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors that more threads wait for than in the dump before."""
    rows, pairs = _dumps(spark, sf_dir)
    return comparison.monitor_changes(pairs, threads.hotspots(rows)).select("pair_id", "monitor", "known", "b_waiters", "c_waiters")


@query(f"WITH {_DUMPS} SELECT pair_id, pool_name, threads AS c_threads, runnable AS c_runnable, blocked AS c_blocked, was AS b_stalled, stalled AS c_stalled FROM pool")
def thread_dump_pool_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools that stall, or stall more than in the dump before."""
    rows, pairs = _dumps(spark, sf_dir)
    return comparison.pool_changes(pairs, threads.pools(rows)).select("pair_id", "pool_name", "c_threads", "c_runnable", "c_blocked", "b_stalled", "c_stalled")


def _dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"))
    pairs = keys.select("pair_id", F.concat(F.lit("t-"), F.col("pair_id").cast("string")).alias("baseline_id"), F.concat(F.lit("t-"), (F.col("pair_id") + 1).cast("string")).alias("current_id"))
    found = threads.kept(r.dump_lines(spark, sf_dir))
    both = found.select(F.col("artifact_id").alias("baseline_id")).distinct()
    return found, pairs.join(both, "baseline_id", "left_semi")


def _tops(families: tuple[str, ...], key: str, prefix: str) -> str:
    """Of each recording the commonest key of some families: its events, and its shares of events and of bytes."""
    listed = ", ".join(f"'{f}'" for f in families)
    return f"""{prefix} AS (SELECT artifact_id, n AS {prefix}_n, n / (sum(n) OVER w)::DOUBLE AS {prefix}_share, CASE WHEN sum(bytes) OVER w > 0 THEN bytes / (sum(bytes) OVER w)::DOUBLE ELSE 0.0 END AS {prefix}_bytes FROM (SELECT artifact_id, {key} AS key, count(*) AS n, sum(size_bytes) AS bytes FROM j WHERE signal_family IN ({listed}) AND {key} IS NOT NULL GROUP BY 1, 2) x WINDOW w AS (PARTITION BY artifact_id)
  QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, bytes DESC, key) = 1)"""


_BUSY = "lock_count + thread_park_count + monitor_wait_count + io_count"
_JFR_RULES = (
    ("jfr-lock-contention-events", "lock_count > 0 AND (lock_max_ms >= 100 OR lock_total_ms >= 500 OR lock_count >= 5)", _when("lock_max_ms >= 1000 OR lock_total_ms >= 5000 OR lock_count >= 20")),
    ("jfr-gc-pause-events", "gc_count > 0 AND (gc_max_ms >= 200 OR gc_total_ms >= 1000)", _when("gc_max_ms >= 1000 OR gc_total_ms >= 5000")),
    ("jfr-thread-park-events", "thread_park_count > 0 AND (thread_park_max_ms >= 100 OR thread_park_total_ms >= 300 OR thread_park_count >= 10)", _when("thread_park_max_ms >= 1000 OR thread_park_total_ms >= 3000 OR thread_park_count >= 50")),
    ("jfr-monitor-wait-events", "monitor_wait_count > 0 AND (monitor_wait_max_ms >= 100 OR monitor_wait_total_ms >= 400 OR monitor_wait_count >= 4)", _when("monitor_wait_max_ms >= 1000 OR monitor_wait_total_ms >= 3000 OR monitor_wait_count >= 12")),
    ("jfr-io-latency-events", "io_count > 0 AND (io_max_ms >= 100 OR io_total_ms >= 300 OR io_count >= 5)", _when("io_max_ms >= 1000 OR io_total_ms >= 3000 OR io_count >= 20")),
    ("jfr-exception-burst", "exception_count >= 20", _when("exception_count >= 100")),
    ("jfr-safepoint-pause-events", "safepoint_count > 0 AND (safepoint_max_ms >= 50 OR safepoint_total_ms >= 200 OR safepoint_count >= 5)", _when("safepoint_max_ms >= 500 OR safepoint_total_ms >= 1500")),
    ("jfr-class-loading-pressure", "class_loading_count >= 5 AND (class_loading_count >= 10 OR class_loading_bytes >= 1000000)", _when("class_loading_count >= 20 OR class_loading_bytes >= 2000000")),
    ("jfr-cpu-load-saturation", "cpu_load_count > 0 AND (peak >= 0.90 OR mean >= 0.75 OR peak_jvm >= 0.80)", _when("peak >= 0.97 OR mean >= 0.85 OR peak_jvm >= 0.90")),
    ("jfr-execution-hot-path", "execution_count >= 5 AND run_n >= 3 AND run_share >= 0.60", _when("execution_count >= 10 OR run_share >= 0.80")),
    ("jfr-runtime-hot-path", f"wait_n >= 2 AND wait_share >= 0.50 AND {_BUSY} >= 3", _when(f"{_BUSY} >= 6 OR wait_share >= 0.75")),
    ("jfr-allocation-churn", "allocation_count >= 5 AND (allocation_bytes >= 8000000 OR largest >= 1000000 OR kind_n >= 5)", _when("allocation_bytes >= 16000000 OR kind_bytes >= 0.80 OR allocation_count >= 10")),
    ("jfr-dominant-allocation-class", "kind_n >= 4 AND (kind_share >= 0.60 OR kind_bytes >= 0.60)", _when("kind_share >= 0.80 OR kind_bytes >= 0.80")),
    ("jfr-allocation-hot-path", "allocation_count >= 5 AND site_n >= 3 AND (site_share >= 0.60 OR site_bytes >= 0.60)", _when("allocation_count >= 8 OR site_share >= 0.80 OR site_bytes >= 0.80")),
    ("jfr-old-object-retention-candidates", "old_object_count >= 2 AND (old_object_bytes >= 512000 OR age >= 60000 OR depth >= 4)", _when("old_object_bytes >= 2000000 OR age >= 300000 OR depth >= 6")),
    ("jfr-dominant-old-object-class", "kept_n >= 2 AND (kept_share >= 0.60 OR kept_bytes >= 0.60)", _when("kept_share >= 0.80 OR kept_bytes >= 0.80")),
    ("jfr-old-object-reference-depth", "deep > 0 AND (depth >= 4 OR mean_depth >= 2.5)", _when("depth >= 8 OR mean_depth >= 4.0")),
)
_LOAD = "CASE WHEN n % 150 BETWEEN 2 AND 100 THEN (n % 150) / 100.0::DOUBLE ELSE (n % 150)::DOUBLE END"


@query(f"""WITH {_JFR}, {_tops(("executionSample",), "top_method", "run")}, {_tops(("lockContention", "monitorWait", "threadPark", "ioLatency", "exceptionBurst", "safepointPause"), "top_method", "wait")}, {_tops(("allocation",), "top_method", "site")}, {_tops(("allocation",), "class_name", "kind")}, {_tops(("oldObject",), "class_name", "kept")},
 d AS (SELECT artifact_id, {_DUR}, max(size_bytes) FILTER (signal_family = 'allocation') AS largest, max(object_age_ms) FILTER (signal_family = 'oldObject') AS age, max(reference_depth) FILTER (signal_family = 'oldObject') AS depth, avg(reference_depth) FILTER (signal_family = 'oldObject' AND reference_depth > 0) AS mean_depth, count(*) FILTER (signal_family = 'oldObject' AND reference_depth > 0) AS deep,
  max({_LOAD}) FILTER (signal_family = 'cpuLoad') AS peak, avg({_LOAD}) FILTER (signal_family = 'cpuLoad') AS mean, max((n % 90) / 100.0::DOUBLE) FILTER (signal_family = 'cpuLoad') AS peak_jvm FROM j GROUP BY 1),
 s AS (SELECT * FROM d LEFT JOIN run USING (artifact_id) LEFT JOIN wait USING (artifact_id) LEFT JOIN site USING (artifact_id) LEFT JOIN kind USING (artifact_id) LEFT JOIN kept USING (artifact_id)) {_rules("s", "artifact_id", _JFR_RULES)}""")
def jfr_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each recording."""
    found = assessment.assess("JFR", jfr.summary(jfr.timeline(r.recording(spark, sf_dir))))
    return found.select("artifact_id", "finding_id", "severity")


@query(f"WITH {_PMAP} SELECT {', '.join(_PMAP_COLUMNS)} FROM s")
def canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each process map as facts of any kind, read back under its types."""
    summary = memory.pmap_summary(r.pmap_lines(spark, sf_dir)).select(*_PMAP_COLUMNS)
    return facts.typed(facts.canonical(summary, "PMAP"), {f.name: f.dataType.simpleString() for f in summary.schema if f.name != facts.KEY})


@query(f"WITH {_PMAP} SELECT field, n FROM (SELECT {', '.join(f'count({c}) AS {c}' for c in _PMAP_COLUMNS[1:])} FROM s) UNPIVOT (n FOR field IN ({', '.join(_PMAP_COLUMNS[1:])})) WHERE n > 0")
def fact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many process maps hold each fact."""
    summary = memory.pmap_summary(r.pmap_lines(spark, sf_dir)).select(*_PMAP_COLUMNS)
    return facts.present(facts.canonical(summary, "PMAP")).groupBy("field").agg(F.sum("n").alias("n"))
