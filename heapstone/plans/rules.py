"""Rule queries: thresholds to findings, severities, staged correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.operators.rules import Rule, Staged, correlate, evaluate, roll_up
from heapstone.plans.base import EVENTS, events, query

RULES = (
    Rule("repeated-errors", "errors >= 10 AND max_value >= 60", "CRITICAL"),
    Rule("saturation", "max_value >= 95", "MEDIUM", (("HIGH", "max_value >= 120"),)),
    Rule("latency", "n >= 3 AND errors < 25 AND average >= 19", "MEDIUM", (("HIGH", "average >= 24"),)),
)

STAGED = (
    Staged("pressure", (("repeated-errors",), ("saturation",)), "HIGH", (("CRITICAL", ("latency",)),)),
    Staged("escalation", (("pressure",), ("latency",)), "CRITICAL"),
    Staged("quiet", (("latency",),), "LOW", (), ("pressure", "repeated-errors")),
)

_FINDINGS = f"""s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) AS max_value, sum(cents)::BIGINT / count(*) / 100.0::DOUBLE AS average FROM {EVENTS} GROUP BY user_id),
 f AS (SELECT user_id, 'repeated-errors' AS finding_id, 'CRITICAL' AS severity, 0 AS position FROM s WHERE errors >= 10 AND max_value >= 60
  UNION ALL SELECT user_id, 'saturation', CASE WHEN max_value >= 120 THEN 'HIGH' ELSE 'MEDIUM' END, 1 FROM s WHERE max_value >= 95
  UNION ALL SELECT user_id, 'latency', CASE WHEN average >= 24 THEN 'HIGH' ELSE 'MEDIUM' END, 2 FROM s WHERE n >= 3 AND errors < 25 AND average >= 19)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("max_value"), (F.sum("cents") / F.count("*") / F.lit(100.0)).alias("average"))
    return evaluate(summary, ["user_id"], RULES)


@query(f"WITH {_FINDINGS} SELECT * FROM f")
def threshold_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each thread by three rules."""
    return _findings(spark, sf_dir)


@query(f"WITH {_FINDINGS} SELECT user_id, count(*) AS n, CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS worst FROM f GROUP BY user_id")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst severity of each thread."""
    return roll_up(_findings(spark, sf_dir), ["user_id"])


@query(f"""WITH {_FINDINGS}, k AS (SELECT user_id, bool_or(finding_id = 'repeated-errors') AS e, bool_or(finding_id = 'saturation') AS s, bool_or(finding_id = 'latency') AS l FROM f GROUP BY user_id)
 SELECT user_id, 'pressure' AS finding_id, CASE WHEN l THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 0 AS position FROM k WHERE e AND s
 UNION ALL SELECT user_id, 'escalation', 'CRITICAL', 1 FROM k WHERE e AND s AND l UNION ALL SELECT user_id, 'quiet', 'LOW', 2 FROM k WHERE l AND NOT (e AND s) AND NOT e""")
def staged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over findings, in order: later ones see what earlier ones emitted."""
    return correlate(_findings(spark, sf_dir), ["user_id"], STAGED)
