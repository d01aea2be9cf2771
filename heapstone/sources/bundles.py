"""Report bundles: each report as text, Markdown, HTML and JSON in a folder of its own, which appears with all of its files or not at all.

``save(reports, folder)`` renders by column expressions and writes through a data source: tasks write into a staging folder, the commit moves
whole bundles into place, and a failed job removes its staging folder. For stores whose folders can be moved.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from heapstone.sources.recordings import _open

#: Files of a bundle and the columns they hold.
FILES = {"report.txt": "text", "report.md": "markdown", "report.html": "html", "report.json": "json"}
_ID = re.compile(r"[\w-][\w.-]*")


def escaped(text: Column) -> Column:
    """Text as it stands in HTML."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def _cell(text: Column) -> Column:
    """Text as it stands in a cell of a Markdown table."""
    return F.replace(F.regexp_replace(text, r"\s*\R\s*", " "), F.lit("|"), F.lit("\\|"))


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, lambda f, i: line(f, (i + 1).cast("string"))), "\n")


def rendered(reports: DataFrame) -> DataFrame:
    """analysis_id, text, markdown, html, json of reports as ``reports.assemble`` makes them; nulls are shown as a dash."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    head = {"Severity": known(F.col("severity")), "Created": known(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")), "Findings": known(F.col("n_findings"))}
    name, findings = F.col("analysis_id"), F.coalesce("findings", F.array().cast("array<struct<artifact_id:string,finding_id:string,severity:string>>"))
    part = lambda f, use: [use(known(f[c])) for c in ("severity", "finding_id", "artifact_id")]
    same = lambda c: c
    text = F.concat(F.lit("Report "), name, F.lit("\n"), *(F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in head.items()), F.lit("\n"), _lines(findings, lambda f, i: F.concat(i, F.lit(". ["), part(f, same)[0], F.lit("] "), part(f, same)[1], F.lit(" in "), part(f, same)[2])), F.lit("\n"))
    markdown = F.concat(F.lit("# Report "), name, F.lit("\n\n"), *(F.concat(F.lit(f"- {k}: "), v, F.lit("\n")) for k, v in head.items()), F.lit("\n| # | severity | finding | artifact |\n|-|-|-|-|\n"), _lines(findings, lambda f, i: F.concat(F.lit("| "), F.concat_ws(" | ", i, *part(f, _cell)), F.lit(" |"))), F.lit("\n"))
    row = lambda f, i: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", i, *part(f, escaped)), F.lit("</td></tr>"))
    html = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), escaped(name), F.lit("</title></head><body>\n<h1>"), escaped(name), F.lit("</h1>\n<dl>"), *(F.concat(F.lit(f"<dt>{k}</dt><dd>"), escaped(v), F.lit("</dd>")) for k, v in head.items()), F.lit("</dl>\n<table>\n"), _lines(findings, row), F.lit("\n</table>\n</body></html>\n"))
    return reports.select(name, text.alias("text"), markdown.alias("markdown"), html.alias("html"), F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("json"))


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, root = _open(self.path)
        names = []
        for row in iterator:
            if not _ID.fullmatch(row["analysis_id"] or ""):
                raise ValueError(f"{row['analysis_id']!r} is not an analysis id")
            folder = f"{root}/{self.staging}/{uuid.uuid4().hex}/{row['analysis_id']}"  # attempts of one task don't meet
            store.create_dir(folder, recursive=True)
            for file, column in FILES.items():
                with store.open_output_stream(f"{folder}/{file}") as out:
                    out.write((row[column] or "").encode())
            names.append(folder.removeprefix(f"{root}/"))
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            target = f"{root}/{name.rsplit('/', 1)[1]}"
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.delete_dir(target)
            store.move(f"{root}/{name}", target)
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class ReportBundles(DataSource):
    """Writes rows of analysis_id, text, markdown, html and json; option path."""

    @classmethod
    def name(cls) -> str:
        return "report_bundle"

    def schema(self) -> str:
        return "analysis_id string, text string, markdown string, html string, json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


def save(reports: DataFrame, path: str) -> None:
    """A bundle for each report; one that is saved again replaces its bundle. A report stands in one row."""
    reports.sparkSession.dataSource.register(ReportBundles)
    rendered(reports).write.format(ReportBundles.name()).mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The reports of all bundles in a folder, from their JSON."""
    from heapstone.sources.reports import SCHEMA

    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "report.json").json(path).where("analysis_id IS NOT NULL")
