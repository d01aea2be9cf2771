"""Report sinks and the catalog of saved reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.functions.redact import redact, redact_report
from heapstone.operators.rules import CONFIDENCES, SEVERITIES, rank

SCHEMA = "analysis_id string, created_at timestamp, severity string, n_findings long, findings array<struct<artifact_id:string,finding_id:string,severity:string>>"


def assemble(findings: DataFrame, analysis: str, created_at) -> DataFrame:
    """One report row for each value of ``analysis``: all findings (repeated ones stay), the highest severity, the time of making."""
    names = F.create_map(*(x for name, place in SEVERITIES.items() for x in (F.lit(place), F.lit(name))))
    listed = F.array_sort(F.collect_list(F.struct("artifact_id", "finding_id", "severity")))
    return findings.groupBy(F.col(analysis).alias("analysis_id")).agg(listed.alias("findings"), F.max(rank(F.col("severity"))).alias("_w")).select("analysis_id", F.lit(created_at).cast("timestamp").alias("created_at"), names[F.col("_w")].alias("severity"), F.size("findings").cast("long").alias("n_findings"), "findings")


def save(reports: DataFrame, path: str) -> None:
    """JSON lines, one report a line, in folders by severity so that catalogs read only what they list."""
    reports.withColumn("_severity", F.col("severity")).write.mode("append").partitionBy("_severity").json(path)


def load(spark: SparkSession, path: str, analysis_id: str | None = None) -> DataFrame:
    """Saved reports; lines that can't be read are passed over here and counted by ``unreadable``. An id with anything but letters, digits, dots and dashes is refused."""
    if analysis_id is not None and not re.fullmatch(r"[\w-][\w.-]*", analysis_id):
        raise ValueError("not an analysis id")
    reports = spark.read.schema(SCHEMA + ", _severity string").json(path).where("analysis_id IS NOT NULL").drop("_severity")
    return reports.where(F.col("analysis_id") == analysis_id) if analysis_id else reports


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path, n: the lines of saved reports that are no report, by file."""
    rows = spark.read.schema(SCHEMA + ", _severity string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "analysis_id").where("analysis_id IS NULL").groupBy("path").agg(F.count("*").alias("n"))


def catalog(reports: DataFrame, severity: str | None = None, finding_id: str | None = None) -> DataFrame:
    """Newest first, those without a time last; filtered by severity and by a finding they hold."""
    found = reports
    if severity:
        found = found.where(F.col("severity") == severity.upper())
    if finding_id:
        found = found.where(F.exists("findings", lambda f: f["finding_id"] == finding_id))
    return found.orderBy(F.desc_nulls_last("created_at"), "analysis_id").select("analysis_id", "created_at", "severity", "n_findings")


def shareable(lines: DataFrame, text: str, keys: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """A text column with secrets, paths, addresses and hosts replaced by tokens: stable within each report (``keys``), or within each text without them."""
    return redact_report(lines, keys, order, text) if keys else lines.withColumn(text, redact(F.col(text)))


__all__ = ["CONFIDENCES", "SCHEMA", "assemble", "catalog", "load", "save", "shareable"]
