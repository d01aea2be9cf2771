"""Bundles hold one report in four formats, appear whole, and read back as they were."""

from __future__ import annotations

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heapstone.sources import bundles, reports

ODD = 'log <a href="x">|\n& more'


@pytest.fixture
def made(spark):
    findings = spark.createDataFrame([("a", "gc-heap-saturation", "HIGH", "r-1"), (ODD, "nmt-gc-native-pressure", "LOW", "r-1"), ("b", "pmap-anon-pressure", "MEDIUM", "r.2")], "artifact_id string, finding_id string, severity string, analysis string")
    return reports.assemble(findings, "analysis", datetime(2026, 3, 1, 12, 30))


def test_four_formats_of_one_report_agree(spark, made, tmp_path):
    bundles.save(made, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["r-1", "r.2"] and sorted(os.listdir(tmp_path / "r-1")) == sorted(bundles.FILES)
    read = lambda name: (tmp_path / "r-1" / name).read_text()
    told = json.loads(read("report.json"))
    assert told["severity"] == "HIGH" and [f["finding_id"] for f in told["findings"]] == ["gc-heap-saturation", "nmt-gc-native-pressure"]
    for name in ("report.txt", "report.md", "report.html"):
        text = read(name)
        assert all(f["finding_id"] in text and f["severity"] in text for f in told["findings"]) and "2026-03-01 12:30:00" in text
    assert "&lt;a href=&quot;x&quot;&gt;" in read("report.html") and "<a href" not in read("report.html")
    assert [line for line in read("report.md").splitlines() if line.startswith("| 2 ")] == ['| 2 | LOW | nmt-gc-native-pressure | log <a href="x">\\| & more |']
    assert read("report.txt").startswith("Report r-1\nSeverity: HIGH\nCreated: 2026-03-01 12:30:00\nFindings: 2\n\n1. [HIGH] gc-heap-saturation in a\n2. ")
    assert sorted(map(str, bundles.load(spark, str(tmp_path)).collect())) == sorted(map(str, made.collect()))


def test_a_bundle_saved_again_is_replaced(spark, made, tmp_path):
    bundles.save(made, f"file://{tmp_path}")
    (tmp_path / "r-1" / "left.over").write_text("x")
    bundles.save(made.where("analysis_id = 'r-1'").withColumn("severity", F.lit("CRITICAL")), str(tmp_path))
    assert sorted(os.listdir(tmp_path / "r-1")) == sorted(bundles.FILES) and "CRITICAL" in (tmp_path / "r-1" / "report.md").read_text()
    assert "MEDIUM" in (tmp_path / "r.2" / "report.md").read_text()


def test_a_failed_task_leaves_no_bundle(spark, made, tmp_path):
    bad = made.unionByName(made.limit(1).withColumn("analysis_id", F.lit("../escape"))).repartition(3)
    with pytest.raises(Exception, match="not an analysis id"):
        bundles.save(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_reports_without_findings_or_times(spark, made, tmp_path):
    bundles.save(made.where("analysis_id = 'r-1'").withColumns({"findings": F.lit(None).cast(made.schema["findings"].dataType), "created_at": F.lit(None).cast("timestamp"), "severity": F.lit(None).cast("string")}), str(tmp_path))
    assert "Severity: -\nCreated: -\n" in (tmp_path / "r-1" / "report.txt").read_text()
    bundles.save(made.where("false"), str(tmp_path))
    assert os.listdir(tmp_path) == ["r-1"]
