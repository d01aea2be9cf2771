"""What of an artifact's index is shown from the start: slices chosen under the budget of a model's context window.

Slices are (artifact_id, slice_id, kind, ordinal, chars): ``kind`` is highlight, structured or raw; ``ordinal`` is their order within the artifact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["artifact_id"]
KINDS = ("highlight", "structured", "raw")
#: The window that is assumed where none is known, and the most of each kind that any budget shows.
DEFAULT_TOKENS, MOST = 8192, {"highlight": 24, "structured": 28, "raw": 24}
#: From how many tokens on which budget holds: highlights, structured slices, raw slices, characters of a structured and of a raw slice.
STEPS = ((65536, (24, 24, 24, 9000, 7600)), (32768, (20, 20, 20, 7200, 5800)), (16384, (16, 18, 18, 5200, 4200)), (0, (12, 12, 12, 2800, 2200)))
COMPACT = ((65536, (12, 14, 12, 4200, 3000)), (32768, (10, 12, 10, 2800, 2000)), (16384, (8, 8, 8, 1800, 1200)), (0, (6, 6, 6, 1400, 900)))
#: A thread dump or GC log of so many characters and lines at most is shown whole.
SMALL_CHARS, SMALL_LINES, SMALL_KINDS = 16_000, 160, ("THREAD_DUMP", "GC_LOG")


@dataclass(frozen=True)
class Budget:
    """Slices of each kind, characters of one slice, and, if given, of all slices together, of which each kind has its first ``reserved`` slices in any case."""

    highlights: int
    structured: int
    raw: int
    structured_chars: int
    raw_chars: int
    total_chars: int | None = None
    reserved: int = 1

    @classmethod
    def of_window(cls, tokens: int | None = None, compact: bool = False, total_chars: int | None = None) -> Budget:
        """The budget of a context window; ``compact`` for small local models."""
        tokens = tokens if tokens and tokens > 0 else DEFAULT_TOKENS
        return cls(*next(values for least, values in (COMPACT if compact else STEPS) if tokens >= least), total_chars=total_chars)

    def limit(self, kind: str) -> int:
        return min(MOST[kind], {"highlight": self.highlights, "structured": self.structured, "raw": self.raw}[kind])

    def widened(self) -> Budget:
        """For an artifact that is small enough to be shown whole."""
        return replace(self, highlights=max(self.highlights, MOST["highlight"]), structured=max(self.structured, MOST["structured"]), raw=max(self.raw, MOST["raw"]), structured_chars=max(self.structured_chars, SMALL_CHARS), raw_chars=max(self.raw_chars, SMALL_CHARS))


def _by_kind(values: dict[str, int]) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in values.items()))


def small(slices: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifact_id, whole: whether an artifact (artifact_id, type, chars, n_lines) is shown whole: short, of a kind that reads well, and without more slices than are ever shown."""
    counts = slices.groupBy(*KEY).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("structured", "raw")))
    fits = F.col("type").isin(*SMALL_KINDS) & F.col("chars").between(1, SMALL_CHARS) & F.col("n_lines").between(1, SMALL_LINES)
    few = (F.coalesce("structured", F.lit(0)) <= MOST["structured"]) & (F.coalesce("raw", F.lit(0)) <= MOST["raw"])
    return artifacts.join(counts, KEY, "left").select(*KEY, F.coalesce(fits & few, F.lit(False)).alias("whole"))


def choose(slices: DataFrame, budget: Budget, whole: DataFrame | None = None) -> DataFrame:
    """slices with place (from 1 within artifact and kind), shown_chars, truncated and chosen; slices of other kinds are never chosen.

    A slice is chosen while its kind has room. With ``total_chars``, the reserved slices of each kind come first, then all others by kind and
    order, each while the characters before it and its own fit. ``whole`` (``small``) widens the budget of artifacts that are shown whole.
    """
    wide = budget.widened()
    own = F.lit(False) if whole is None else F.coalesce("whole", F.lit(False))
    marked = slices if whole is None else slices.join(whole, KEY, "left")
    per_kind = lambda b: _by_kind({k: b.limit(k) for k in KINDS})
    per_slice = lambda b: _by_kind({"highlight": b.structured_chars, "structured": b.structured_chars, "raw": b.raw_chars})
    limit, chars = F.when(own, per_kind(wide)).otherwise(per_kind(budget)), F.when(own, per_slice(wide)).otherwise(per_slice(budget))
    place = F.row_number().over(Window.partitionBy(*KEY, "kind").orderBy("ordinal", "slice_id"))
    placed = marked.withColumns({"place": place, "_limit": F.coalesce(limit, F.lit(0)), "_most": chars})
    sized = placed.withColumn("shown_chars", F.least("chars", F.coalesce("_most", F.lit(0)))).withColumn("truncated", F.col("chars") > F.col("_most"))
    fits = F.col("place") <= F.col("_limit")
    if budget.total_chars is not None:
        held = (F.col("place") <= budget.reserved) & fits
        order = [F.when(held, 0).otherwise(1), _by_kind({k: n for n, k in enumerate(KINDS)}), "place"]
        upto = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        candidates = sized.where(fits).withColumn("_sum", F.sum("shown_chars").over(upto))  # at most MOST rows an artifact and kind
        chosen = candidates.where(held | (F.col("_sum") <= budget.total_chars)).select(*KEY, "slice_id", "kind", "ordinal", F.lit(True).alias("chosen"))
        sized = sized.join(chosen, [*KEY, "slice_id", "kind", "ordinal"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    else:
        sized = sized.withColumn("chosen", fits)
    return sized.withColumn("truncated", F.col("chosen") & F.col("truncated")).drop("_limit", "_most", "whole")


def coverage(chosen: DataFrame) -> DataFrame:
    """artifact_id, shown, omitted_structured, omitted_raw, truncated, chars, more: what the start of a session holds and what it leaves for later."""
    left = lambda kind: F.count_if((F.col("kind") == kind) & ~F.col("chosen"))
    sums = chosen.groupBy(*KEY).agg(F.count_if("chosen").alias("shown"), left("structured").alias("omitted_structured"), left("raw").alias("omitted_raw"), F.count_if("truncated").alias("truncated"), F.coalesce(F.sum(F.when(F.col("chosen"), F.col("shown_chars"))), F.lit(0)).alias("chars"))
    return sums.withColumn("more", (F.col("omitted_structured") > 0) | (F.col("omitted_raw") > 0))
