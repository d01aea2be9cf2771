"""The order of snapshots by the best evidence there is for all of them: capture time, roles in file names (of pairs), dates in file names, time of change, input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of file names that tell the earlier and the later one of a pair.
EARLIER = ("baseline", "base", "before", "older", "old", "previous", "prev", "earlier", "first", "initial")
LATER = ("current", "after", "newer", "new", "latest", "last", "final")
#: Dates in file names, the first pattern that fits, with the layout of its digits.
STAMPS = (
    (r"(?<!\d)(\d{4})[-_](\d{2})[-_](\d{2})[T _-](\d{2})[-_.:](\d{2})[-_.:](\d{2})(?!\d)", 6),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})[T_-]?(\d{2})(\d{2})(\d{2})(?!\d)", 6),
    (r"(?<!\d)(\d{4})[-_](\d{2})[-_](\d{2})(?!\d)", 3),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", 3),
)


def name_time(name: Column) -> Column:
    """Microseconds of the date (and time) that a file's name holds, as UTC; null without a valid one."""
    def one(pattern: str, parts: int) -> Column:
        text = F.concat_ws("-", *(F.regexp_extract(name, pattern, g) for g in range(1, 4)))
        clock = F.concat_ws(":", *(F.regexp_extract(name, pattern, g) for g in range(4, 7))) if parts == 6 else F.lit("00:00:00")
        return F.when(name.rlike(pattern), F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" "), clock, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssxxx"))))

    return F.coalesce(*(one(*s) for s in STAMPS))


def name_role(name: Column) -> Column:
    """0 for a name of an earlier snapshot, 1 for a later one, null for neither or both."""
    parts = F.split(F.lower(name), "[^a-z0-9]+")
    early, late = (F.arrays_overlap(parts, F.array(*map(F.lit, words))) for words in (EARLIER, LATER))
    return F.when(early & ~late, 0).when(late & ~early, 1)


def capture_time(lines: DataFrame) -> DataFrame:
    """artifact_id, captured_us: the time on a thread dump's first lines, ``Capture time: ...`` or a bare date and time before any other text; as UTC."""
    trimmed = F.trim("line")
    explicit = F.regexp_extract(trimmed, r"(?i)^Capture\s+time\s*:\s*(.+?)$", 1)
    bare = F.regexp_extract(trimmed, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,9})?)$", 1)
    text = F.when(explicit != "", explicit).when(bare != "", bare)
    found = lines.where((F.col("line_no") <= 20) & text.isNotNull()).groupBy("artifact_id").agg(F.min_by(text, "line_no").alias("t"))
    return found.select("artifact_id", F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp("t"), F.current_timezone())).alias("captured_us"))


def ordered(snapshots: DataFrame, group: list[str], given: str, pairs: bool = False) -> DataFrame:
    """group, the ``given`` order's column, basis, position: each group by the first basis that all its snapshots have and that tells them apart.

    snapshots: group, given, captured_us, name, modified_us; with ``pairs`` roles in file names count after capture times.
    """
    everything = Window.partitionBy(*group)
    bases = [("capture-time", F.col("captured_us")), *([("filename-role", name_role(F.col("name")).cast("long"))] if pairs else []), ("filename-time", name_time(F.col("name"))), ("modified-time", F.col("modified_us"))]
    rows = snapshots
    for k, (_, value) in enumerate(bases):
        rows = rows.withColumn(f"_v{k}", value)
    basis, key = F.lit("input"), F.lit(0).cast("long")
    for k in range(len(bases) - 1, -1, -1):
        known = (F.count(f"_v{k}").over(everything) == F.count("*").over(everything)) & (F.min(f"_v{k}").over(everything) != F.max(f"_v{k}").over(everything))
        rows = rows.withColumn(f"_k{k}", F.coalesce(known, F.lit(False)))
        basis, key = F.when(F.col(f"_k{k}"), F.lit(bases[k][0])).otherwise(basis), F.when(F.col(f"_k{k}"), F.col(f"_v{k}")).otherwise(key)
    chosen = rows.withColumn("basis", basis).withColumn("_key", key)
    return chosen.withColumn("position", F.row_number().over(everything.orderBy("_key", given))).select(*group, given, "basis", "position")
