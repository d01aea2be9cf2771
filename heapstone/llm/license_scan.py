"""Licence scan by ordered signature rules (native: DataFrame expressions only).

A text becomes its words in lower case. The keywords it holds choose the rules that are tried at all; each of these gives the places of its
pattern as intervals of words. An interval within one of a rule of the same or a stronger kind is suppressed, of equal ones the rule of higher
priority stays: one sweep over a text's intervals by start. Texts are read once and never shuffled, only the places found are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.llm.common import Store, pick
from heapstone.llm.license_rules import KINDS, Rule, rules

#: Runs of characters that part words, before letters are lowered.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_line(text: Column) -> Column:
    """All words in order, each between single spaces: ``" mit license "``; only A-Z are lowered to letters of a-z."""
    # lower() makes the Kelvin sign the letter k; any other letter that isn't ASCII in its place keeps words what they are
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(plain, GAP, " "))), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(values: list, kind: str) -> Column:
    """A constant, kept as one value of the plan."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), kind)


def _hits(line: Column, book: list[Rule]) -> Column:
    """array of (rule, gaps, lens): for each rule that matches, the words before each place since the last one, and the place's words."""
    keywords = _table(sorted({r.keyword for r in book}), "array<string>")
    table = _table([{"rule": n, "keyword": r.keyword, "pattern": f"(?<= )(?:{r.pattern})(?= )"} for n, r in enumerate(book)], "array<struct<rule:int,keyword:string,pattern:string>>")

    def tried(held: Column) -> Column:
        chosen = F.filter(table, lambda r: F.array_contains(held, r["keyword"]))
        found = F.filter(F.transform(chosen, lambda r: F.struct(r["rule"].alias("rule"), r["pattern"].alias("pattern"), F.regexp_extract_all(line, r["pattern"], F.lit(0)).alias("places"))), lambda h: F.size(h["places"]) > 0)
        return F.transform(found, lambda h: F.struct(h["rule"].alias("rule"), F.transform(F.split(line, h["pattern"], -1), lambda g: _spaces(g) - 1).alias("gaps"), F.transform(h["places"], lambda p: _spaces(p) + 1).alias("lens")))

    return _let(F.filter(keywords, lambda k: F.contains(line, k)), tried)


def _attribute(book: list[Rule], of: Callable[[Rule], object]) -> Column:
    values = [of(r) for r in book]
    kind = {bool: "boolean", int: "int", str: "string"}[type(values[0])]
    return F.element_at(_table(values, f"array<{kind}>"), F.col("rule") + 1)


def scan(docs: DataFrame, store: Store, book: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored rows (row, doc_id, n_words, hits), and detections: row, doc_id, rule, label, kind, base, start, end (words from 0), suppressed.

    ``row`` numbers the rows of the table, as ids may repeat or be null. Null and empty texts have no words and no detections.
    """
    book = book or rules()
    told = _let(words_line(F.col("text")), lambda line: F.struct(F.greatest(_spaces(line) - 1 - (line == F.lit("  ")).cast("int"), F.lit(0)).cast("long").alias("n_words"), _hits(line, book).alias("hits")))
    scanned = pick(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", told.alias("t"))
    rows = store.keep(scanned.select("row", "doc_id", "t.n_words", "t.hits"))
    hit = rows.where(F.size("hits") > 0).select("row", "doc_id", F.explode("hits").alias("h"))
    places = hit.select("row", "doc_id", F.col("h.rule").alias("rule"), F.posexplode(F.arrays_zip(F.slice("h.gaps", F.lit(1), F.size("h.lens")).alias("gap"), F.col("h.lens").alias("len"))).alias("k", "p")).repartition("row")
    of_rule = Window.partitionBy("row", "rule").orderBy("k")
    end = F.sum(F.col("p.gap") + F.col("p.len")).over(of_rule.rowsBetween(Window.unboundedPreceding, 0))
    spans = places.select("row", "doc_id", "rule", (end - F.col("p.len")).alias("start"), (end - 1).alias("end"))
    known = spans.withColumns({"label": _attribute(book, lambda r: r.label), "kind": _attribute(book, lambda r: r.kind), "base": _attribute(book, lambda r: r.base)})
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("end"))).over(before), F.lit(-1)) for k in range(len(KINDS))]
    inside = [(F.col("kind") >= k) & (reach[k] >= F.col("end")) for k in range(len(KINDS))]
    suppressed = inside[0]
    for one in inside[1:]:
        suppressed = suppressed | one
    return rows, known.withColumn("suppressed", suppressed)


def detections(docs: DataFrame, book: list[Rule] | None = None) -> DataFrame:
    """doc_id, label, kind, start, end (in words from 0, inclusive), score of the detections that stand. A text's repeated rows give theirs each."""
    store = Store(docs.sparkSession, "licences")
    _, found = scan(docs, store, book)
    names, worth = list(KINDS), list(KINDS.values())
    return found.where("NOT suppressed").select("doc_id", "label", F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1).alias("kind"), "start", "end", F.element_at(F.array(*map(F.lit, worth)), F.col("kind") + 1).alias("score"))


def scan_documents(docs: DataFrame, book: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each document.

    Base phrases count at all their places and keep their labels even where a longer finding covers them; other labels are those of detections
    that stand. The score is that of the strongest kind found, 0 without any. A row without a finding has n_base 0, null words and empty labels.
    Rows that repeat are scanned each; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "licences")
    rows, found = scan(docs, store, book)
    base, stands = F.col("base"), ~F.col("suppressed")
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    worth = F.element_at(F.array(*map(F.lit, KINDS.values())), F.col("kind") + 1)
    told = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set(F.when(base | stands, F.col("label")))).alias("labels"), F.max(F.when(stands, worth)).alias("score"),
    )
    none = F.lit("")
    return rows.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
