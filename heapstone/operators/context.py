"""The retrieval surface over raw lines: chunks, ranges, pattern windows, sections, paging, selectors, budgets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no (from 1), line: one row for each line, trailing empty ones included; null text gives none."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), r"\R", -1)).alias("_p", "line")).select(*keys, (F.col("_p") + 1).alias("line_no"), "line")


def chunks(line_rows: DataFrame, keys: list[str], size: int = 24, first: int = 1) -> DataFrame:
    """keys, chunk_id, first_line, last_line, text: fixed blocks of ``size`` lines from line ``first``."""
    placed = line_rows.where(F.col("line_no") >= first).withColumn("_c", F.floor((F.col("line_no") - first) / size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    grouped = placed.groupBy(*keys, "_c").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), text.alias("text"))
    return grouped.select(*keys, F.format_string("raw-chunk-%03d", F.col("_c") + 1).alias("chunk_id"), "first_line", "last_line", "text")


def line_range(line_rows: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of an inclusive range; ends in the wrong order are swapped, the start is 1 at least."""
    low, high = min(first, last), max(first, last)
    return line_rows.where(F.col("line_no").between(max(1, low), high))


def pattern_windows(line_rows: DataFrame, keys: list[str], pattern: str, before: int = 2, after: int = 17, limit: int = 3) -> DataFrame:
    """keys, match_line, position, first_line, last_line, more: windows around the first ``limit`` lines that hold ``pattern`` (any case), cut at the text's ends."""
    ends = line_rows.groupBy(*keys).agg(F.max("line_no").alias("_last"))
    hits = line_rows.where(F.lower("line").contains(pattern.lower())).select(*keys, F.col("line_no").alias("match_line"))
    everything = Window.partitionBy(*keys)
    ranked = hits.withColumn("position", F.row_number().over(everything.orderBy("match_line"))).withColumn("more", F.count("*").over(everything) > limit).where(F.col("position") <= limit)
    return ranked.join(ends, keys).select(*keys, "match_line", "position", F.greatest(F.lit(1), F.col("match_line") - before).alias("first_line"), F.least(F.col("_last"), F.col("match_line") + after).alias("last_line"), "more")


def section_of(line_rows: DataFrame, keys: list[str], header: Column, out: str = "section") -> DataFrame:
    """Adds the last header (null where ``header`` is null) at or before each line."""
    return line_rows.withColumn(out, F.last(header, True).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))


def snippet_lines(line_rows: DataFrame, keys: list[str], snippets: DataFrame) -> DataFrame:
    """keys, snippet, line_numbers: where each snippet of its key (keys, snippet) stands; a repeated snippet counts once.

    A word of a snippet between two others is a whole word of every line that holds the snippet, so the longest one joins it to the lines with
    that word; only snippets of one or two words meet all lines of their key. Words go to that join as hashes, without their line, which is
    joined again where a word meets; so the lines are not written once for each of their words, and whole lines need no join of their own.
    """
    text, words = F.trim("snippet"), F.split(F.trim("snippet"), r"\s+")
    inner = F.array_max(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = snippets.where(text != "").select(*keys, "snippet").distinct()
    numbered = line_rows.select(*keys, "line_no", "line")
    by_word = numbered.select(*keys, "line_no", F.explode(F.array_distinct(F.transform(F.split(F.trim("line"), r"\s+"), lambda w: F.hash(w)))).alias("_hash"))
    inside = wanted.where(F.size(words) > 2).withColumn("_hash", F.hash(inner))
    long = by_word.join(inside, [*keys, "_hash"]).join(numbered, [*keys, "line_no"]).where(F.col("line").contains(text)).select(*keys, "snippet", "line_no")
    short = numbered.join(wanted.where(F.size(words) <= 2), keys).where(F.col("line").contains(text)).select(*keys, "snippet", "line_no")
    return long.unionByName(short).groupBy(*keys, "snippet").agg(F.array_sort(F.collect_set("line_no")).alias("line_numbers"))


#: The lines of a text times its characters, up to which its snippets are matched where the text is read: a second or so.
AT_ONCE = 500_000_000


def matched_at_once(text: Column, most: int | None = None) -> Column:
    """Whether ``own_snippet_lines`` should take a text whole; lines are counted only where the length leaves it open."""
    size, most = F.length(text).cast("long"), AT_ONCE if most is None else most
    return ((size + 1) * size <= most) | (F.size(F.split(text, r"\R", -1)) * size <= most)


def own_snippet_lines(texts: DataFrame, keys: list[str], text: str, snippets: Callable[[Column], Column]) -> DataFrame:
    """keys, snippet, line_numbers: where trimmed snippets of each text, which ``snippets`` makes from the array of its lines, stand on these lines.

    Like ``snippet_lines`` for one text a key, but nothing is shuffled or written, whatever the text's words are; the work is the lines times the characters.
    """

    def found(lines: Column) -> Column:
        wanted = F.array_distinct(F.filter(snippets(lines), lambda s: s != ""))
        numbers = lambda s: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda k: lines[k - 1].contains(s))
        return F.filter(F.transform(wanted, lambda s: F.struct(s.alias("snippet"), numbers(s).alias("line_numbers"))), lambda x: F.size(x["line_numbers"]) > 0)

    split = F.array(F.split(F.col(text), r"\R", -1))  # one element, so that it is a variable of ``found`` and split once
    return texts.select(*keys, F.explode(F.transform(split, found)[0]).alias("_f")).select(*keys, "_f.snippet", "_f.line_numbers")


def page(text: Column, offset: int, length: int = 4200) -> Column:
    """text, first and last character (from 1), total and whether more follows."""
    total = F.length(text)
    start = F.least(F.lit(max(0, offset)), total)
    piece = F.substring(text, start + 1, F.lit(length))
    return F.struct(piece.alias("text"), (start + 1).alias("first_char"), (start + F.length(piece)).alias("last_char"), total.alias("total"), (start + F.length(piece) < total).alias("more"))


def pages(text: Column, length: int = 4200) -> Column:
    """An array of structs like those of ``page``: all pages of a text, cut in one pass; an empty text has one empty page."""
    total = F.length(text)
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    pieces = F.when(total > 0, found).otherwise(F.array(F.lit("")))

    def numbered(piece: Column, k: Column) -> Column:
        last = k * length + F.length(piece)
        return F.struct(piece.alias("text"), (k * length + 1).alias("first_char"), last.alias("last_char"), total.alias("total"), (last < total).alias("more"))

    return F.transform(pieces, numbered)


#: Keys that selectors know; anything else stays a free key.
_PAIR = re.compile(r"[,;\n]")


@dataclass(frozen=True)
class Selector:
    """``key=value`` pairs split at commas, semicolons and line ends; keys in lower case, blanks dropped, the last of a key wins.

    A request without any pair is free text, held as ``pattern``.
    """

    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, request: str | None) -> Selector:
        found: dict[str, str] = {}
        for part in _PAIR.split(request or ""):
            key, mark, value = part.partition("=")
            if mark and key.strip() and value.strip():
                found[key.strip().lower()] = value.strip()
        if not found and (request or "").strip():
            found["pattern"] = request.strip()
        return cls(found)

    def get(self, *names: str) -> str | None:
        return next((self.values[n.lower()] for n in names if n.lower() in self.values), None)

    def number(self, *names: str) -> float | None:
        try:
            return float(self.get(*names) or "x")
        except ValueError:
            return None

    def matching(self, columns: dict[str, str]) -> Column:
        """Rows that fit every pair whose key is in ``columns`` (key: column): contained text in any case."""
        fits = F.lit(True)
        for key, column in columns.items():
            wanted = self.get(key)
            if wanted:
                fits = fits & F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).contains(wanted.lower())
        return fits


#: Calls that a session allows by kind of work: in all, retrievals, for one artifact (None: no bound).
BUDGETS = {"analyze": (12, 8, None), "compare": (16, 10, None), "sequence": (20, 12, 4), "correlate": (24, 16, 6)}


class Session:
    """Counts tool calls against a budget and remembers which slices were seen. Refused retrievals are recorded, refused computations aren't."""

    def __init__(self, kind: str):
        self.total, self.retrievals, self.each = BUDGETS[kind]
        self.calls: list[tuple[str, str, str, bool]] = []
        self.seen: set[tuple[str, str]] = set()

    def allow(self, artifact: str, slice_id: str, retrieval: bool) -> bool:
        used = [c for c in self.calls if c[3]]
        fits = len(used) < self.total and (self.each is None or sum(c[0] == artifact for c in used) < self.each)
        if retrieval:
            fits = fits and sum(c[2] == "retrieve" for c in used) < self.retrievals
        if fits or retrieval:
            self.calls.append((artifact, slice_id, "retrieve" if retrieval else "compute", fits))
        if fits:
            self.seen.add((artifact, slice_id))
        return fits


def next_unseen(slices: DataFrame, seen: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first slice of each key that ``seen`` (keys, slice_id) doesn't hold."""
    left = slices.join(seen, [*keys, "slice_id"], "left_anti")
    return left.groupBy(*keys).agg(F.min(F.struct(order, "slice_id")).alias("s")).select(*keys, F.col("s.slice_id").alias("slice_id"))
