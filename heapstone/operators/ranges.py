"""Ranges of lines joined to what lies in them, by blocks of lines: an equal join on artifact and block, so the work follows the lines that are shown.

Ranges are (artifact_id, first_line, last_line, ...), both ends inclusive. A range meets as many blocks as it is long over the size of a block,
which is never more than the lines it holds; without blocks every range of an artifact would meet every line of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["artifact_id"]
#: Lines of a block: about the length of a range.
BLOCK = 64


def _block(line: Column, size: int) -> Column:
    return F.floor(line / size)


def points_in(ranges: DataFrame, points: DataFrame, line: str = "line_no", block: int = BLOCK, how: str = "inner") -> DataFrame:
    """Each range with each of its points: the columns of both, ``points`` having artifact_id and ``line``. ``how`` may keep ranges without any."""
    cut = ranges.withColumn("_block", F.explode(F.sequence(_block(F.col("first_line"), block), _block(F.greatest("last_line", "first_line"), block))))
    placed = points.withColumn("_block", _block(F.col(line), block)).withColumnsRenamed({"artifact_id": "_artifact", "_block": "_at"})
    same = (F.col("artifact_id") == F.col("_artifact")) & (F.col("_block") == F.col("_at")) & F.col(line).between(F.col("first_line"), F.col("last_line"))
    return cut.join(placed, same, how).drop("_block", "_at", "_artifact")


def text_of(ranges: DataFrame, lines: DataFrame, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """keys, first_line, last_line, text: the raw lines of each range; a text is as long as its range."""
    keys = keys or KEY
    own = [*keys, "first_line", "last_line"]
    joined = points_in(ranges.select(*own).distinct(), lines.select("artifact_id", "line_no", "line"), block=block)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return joined.groupBy(*own).agg(text.alias("text"))


def numbered_text(ranges: DataFrame, lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As ``text_of``, with the number before each line: ``   12 | text``, six places wide."""
    shown = lines.withColumn("line", F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit(" | "), F.col("line")))
    return text_of(ranges, shown, keys)


def nearby(events: DataFrame, marks: DataFrame, same: str, radius: int) -> DataFrame:
    """Each event with the first and last line of the marks (artifact_id, ``same``, line_no) that have its value of ``same`` within ``radius`` lines: adds _first, _last.

    An event without such a mark, or whose value is null, has its own line for both. Blocks of ``radius`` lines keep values that recur all over a log apart.
    """
    numbered = events.withColumn("_id", F.struct("artifact_id", "line_no", same))
    wanted = numbered.select("artifact_id", same, "line_no").where(F.col(same).isNotNull()).distinct()
    cut = wanted.withColumn("_b", F.explode(F.sequence(_block(F.col("line_no") - radius, radius), _block(F.col("line_no") + radius, radius))))
    at = marks.select("artifact_id", same, F.col("line_no").alias("_at")).withColumn("_b", _block(F.col("_at"), radius))
    near = cut.join(at, ["artifact_id", same, "_b"]).where(F.abs(F.col("_at") - F.col("line_no")) <= radius)
    ends = near.groupBy("artifact_id", same, "line_no").agg(F.min("_at").alias("_f"), F.max("_at").alias("_l"))
    joined = events.join(ends, ["artifact_id", same, "line_no"], "left")
    return joined.withColumn("_first", F.least("line_no", F.coalesce("_f", "line_no"))).withColumn("_last", F.greatest("line_no", F.coalesce("_l", "line_no"))).drop("_f", "_l")
