"""Queries that give raw lines: ranges of incidents, streaks and windows of GC logs, texts of ranges, and what a budget shows from the start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators import budget, ranges, retrieval
from heapstone.operators.context import Selector
from heapstone.parse import gc
from heapstone.plans import rendered as r
from heapstone.plans.base import query
from heapstone.plans.parsed import _CLUSTER
from heapstone.plans.viewed import _DOCS, _MERGE, _documents
from heapstone.views import gc_ranges

_ENDS = "ends AS (SELECT artifact_id, max(line_no) AS last FROM q GROUP BY 1)"
#: Distress, and for each such event the window of 48 lines that begins with it.
_DENSE = """d AS (SELECT artifact_id, line_no, CASE WHEN kind = 'signal' THEN 26000 ELSE greatest(1000, c * 10) END AS w FROM q WHERE event_type = 'error' OR kind = 'signal'),
 wide AS (SELECT artifact_id, line_no AS a, max(line_no) OVER o AS b, count(*) OVER o AS n, sum(w) OVER o AS w FROM d WINDOW o AS (PARTITION BY artifact_id ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 48 FOLLOWING))"""


@query(f"""WITH {r.GC_SQL}, {_ENDS}, {_DENSE},
 best AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, w DESC, b - a, a) = 1),
 longest AS (SELECT artifact_id, arg_max(line_no, {{'c': c, 'l': -line_no}}) AS line_no FROM q WHERE event_type = 'error' GROUP BY 1),
 stalled AS (SELECT artifact_id, arg_max(line_no, {{'c': c, 'l': -line_no}}) AS line_no FROM q WHERE kind = 'stall' GROUP BY 1),
 peak AS (SELECT artifact_id, arg_max(line_no, {{'c': after_ratio, 'l': -line_no}}) AS line_no FROM p WHERE after_ratio > 0 GROUP BY 1),
 dense AS (SELECT * FROM wide WHERE n >= 2 AND n = (SELECT max(n) FROM wide v WHERE v.artifact_id = wide.artifact_id) QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY n DESC, b - a, a) = 1),
 exhausted AS (SELECT artifact_id, min(line_no) AS line_no FROM q WHERE kind = 'signal' GROUP BY 1),
 s AS (SELECT artifact_id, 'gc-incident-dominant-g1-distress-window' AS slice_id, a - 5 AS lo, b + 5 AS hi, n FROM best
  UNION ALL SELECT artifact_id, 'gc-incident-first-to-space-distress', line_no - 5, line_no + 5, 1 FROM exhausted UNION ALL SELECT artifact_id, 'gc-incident-longest-full-gc', line_no - 5, line_no + 5, 1 FROM longest
  UNION ALL SELECT artifact_id, 'gc-incident-longest-allocation-stall', line_no - 5, line_no + 5, 1 FROM stalled UNION ALL SELECT artifact_id, 'gc-incident-peak-occupancy', line_no - 5, line_no + 5, 1 FROM peak
  UNION ALL SELECT artifact_id, 'gc-incident-densest-failure-region', a - 3, b + 3, n FROM dense UNION ALL SELECT artifact_id, 'gc-incident-tail', last - 23, last, 0 FROM ends)
 SELECT artifact_id, slice_id, greatest(1, lo)::INT AS first_line, least(last, hi)::INT AS last_line, n FROM s JOIN ends USING (artifact_id)""")
def gc_incident_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines of every incident of each log."""
    lines = r.gc_lines(spark, sf_dir)
    return gc_ranges.incident_slices(gc.stored_events(lines), lines, gc.collectors(r.gc_artifacts(spark, sf_dir)))


@query(f"""WITH {_CLUSTER}, {_ENDS}, m AS (SELECT n.artifact_id, n.line_no, CASE WHEN n.kind = 'signal' THEN 1000 ELSE greatest(1000, c * 10) END AS w FROM n JOIN best USING (artifact_id, streak, cluster) WHERE streak = 'distress'),
 roles AS (SELECT artifact_id, line_no, row_number() OVER (PARTITION BY artifact_id ORDER BY w DESC, line_no DESC) AS heavy, row_number() OVER (PARTITION BY artifact_id ORDER BY line_no) AS early, row_number() OVER (PARTITION BY artifact_id ORDER BY line_no DESC) AS late FROM m),
 chosen AS (SELECT artifact_id, line_no, CASE WHEN heavy = 1 THEN 0 WHEN early = 1 THEN 1 ELSE 2 END AS role FROM roles WHERE heavy = 1 OR early = 1 OR late = 1)
 SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY role)::INT AS position, greatest(1, line_no - 2)::INT AS first_line, least(last, line_no + 17)::INT AS last_line, line_no, false AS more FROM chosen JOIN ends USING (artifact_id)""")
def gc_streak_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines around the heaviest, first and last event of each log's streak of distress."""
    lines = r.gc_lines(spark, sf_dir)
    return gc_ranges.streak(gc.stored_events(lines), lines, "Distress").select("artifact_id", "position", "first_line", "last_line", "line_no", "more")


@query(f"""WITH {r.GC_SQL}, {_ENDS}, w AS (SELECT artifact_id, min(line_no) AS a, max(line_no) AS b, count(*) AS n FROM q WHERE elapsed_s BETWEEN 20 AND 65 AND kind <> 'worker' GROUP BY 1)
 SELECT artifact_id, 20.0::DOUBLE AS lo, 65.0::DOUBLE AS hi, greatest(1, a - 2)::INT AS first_line, least(last, b + 17)::INT AS last_line, n FROM w JOIN ends USING (artifact_id)""")
def gc_window_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of all events in a window of seconds that a start and a width name."""
    lines = r.gc_lines(spark, sf_dir)
    found = gc.stored_events(lines, ("artifact_id", "line_no", "gc_id", "elapsed_s", "kind"))  # seconds are named, so clocks and texts of lines aren't read
    return gc_ranges.time_window(found, lines, Selector.parse("start=20s; windowSeconds=45"))


@query(f"""WITH {_DOCS}, x AS (SELECT artifact_id, greatest(1, line_no - 5) AS a, least(last, line_no + 5) AS b FROM l JOIN ends USING (artifact_id) WHERE contains(lower(line), 'tion the')), {_MERGE}
 SELECT artifact_id, first_line::INT AS first_line, last_line::INT AS last_line, string_agg(lpad(line_no::VARCHAR, 6, ' ') || ' | ' || line, chr(10) ORDER BY line_no) AS text FROM m JOIN l USING (artifact_id) WHERE line_no BETWEEN first_line AND last_line GROUP BY 1, 2, 3""")
def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered text of every evidence window."""
    lines = _documents(spark, sf_dir)
    found = retrieval.evidence_windows(lines.where(F.lower("line").contains("tion the")).select("artifact_id", "line_no"), lines)
    return ranges.numbered_text(found, lines)


@query(f"""WITH {_DOCS}, x AS (SELECT artifact_id, greatest(1, line_no - 5) AS a, least(last, line_no + 5) AS b FROM l JOIN ends USING (artifact_id) WHERE contains(lower(line), 'tion the')), {_MERGE},
 s AS (SELECT artifact_id, 'structured' AS kind, 'evidence-' || lpad((row_number() OVER (PARTITION BY artifact_id ORDER BY first_line))::VARCHAR, 3, '0') AS slice_id, first_line, last_line, 0 AS o FROM m
  UNION ALL SELECT artifact_id, 'raw', 'raw-chunk-' || lpad(((line_no - 1) // 24 + 1)::VARCHAR, 3, '0'), min(line_no), max(line_no), 1 FROM l GROUP BY artifact_id, (line_no - 1) // 24),
 t AS (SELECT s.artifact_id, kind, slice_id, first_line, o, sum(length(line) + 1)::BIGINT - 1 AS chars FROM s JOIN l ON l.artifact_id = s.artifact_id AND line_no BETWEEN first_line AND last_line GROUP BY 1, 2, 3, 4, 5),
 p AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, kind ORDER BY first_line, slice_id)::INT AS place, least(chars, CASE kind WHEN 'raw' THEN 2200 ELSE 2800 END) AS shown FROM t),
 u AS (SELECT *, sum(shown) OVER (PARTITION BY artifact_id ORDER BY CASE WHEN place <= 1 THEN 0 ELSE 1 END, o, place ROWS UNBOUNDED PRECEDING) AS upto FROM p WHERE place <= 12)
 SELECT artifact_id, slice_id, place, chars, shown AS shown_chars, shown < chars AS truncated FROM u WHERE place <= 1 OR upto <= 6000""")
def starting_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of each text that the start of a session shows within 6,000 characters, under the budget of a small window."""
    lines = _documents(spark, sf_dir)
    slices = retrieval.index(lines, lines.where(F.lower("line").contains("tion the")).select("artifact_id", "line_no"))
    sizes = ranges.points_in(slices.select("artifact_id", "slice_id", "first_line", "last_line"), lines).groupBy("artifact_id", "slice_id").agg((F.sum(F.length("line") + 1) - 1).alias("chars"))
    kinds = F.when(F.col("kind") == "raw", "raw").otherwise("structured")
    chosen = budget.choose(slices.join(sizes, ["artifact_id", "slice_id"]).withColumn("kind", kinds), budget.Budget.of_window(8192, total_chars=6000))
    return chosen.where("chosen").select("artifact_id", "slice_id", "place", "chars", "shown_chars", "truncated")
