"""Threshold rules: conditions on one wide summary row become finding rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of severity and confidence.
SEVERITIES = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CONFIDENCES = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


@dataclass(frozen=True)
class Rule:
    """Fires where ``condition`` (SQL on the summary's columns) holds. Severity is the first of ``levels`` (name, condition) that holds, else ``otherwise``."""

    id: str
    condition: str
    otherwise: str
    levels: tuple[tuple[str, str], ...] = ()

    def severity(self) -> Column:
        chosen = F.lit(self.otherwise)
        for name, condition in reversed(self.levels):
            chosen = F.when(F.expr(condition), F.lit(name)).otherwise(chosen)
        return chosen


def evaluate(summary: DataFrame, keys: list[str], rules: Sequence[Rule], unknown_as: dict[str, object] | None = None) -> DataFrame:
    """keys, finding_id, severity, position: a row for each rule that fires, in the rules' order. Unknown (null) conditions don't fire.

    All rules are one array expression over a single scan. ``unknown_as`` fills columns that the summary lacks or holds null.
    """
    filled = summary
    for name, value in (unknown_as or {}).items():
        filled = filled.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in summary.columns else F.lit(value))
    fired = [F.when(F.expr(r.condition), F.struct(F.lit(r.id).alias("finding_id"), r.severity().alias("severity"), F.lit(k).alias("position"))) for k, r in enumerate(rules)]
    found = F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("f")
    return filled.select(*keys, found).select(*keys, "f.finding_id", "f.severity", "f.position")


def rank(severity: Column) -> Column:
    ranked = F.lit(0)
    for name, place in SEVERITIES.items():
        ranked = F.when(severity == name, F.lit(place)).otherwise(ranked)
    return ranked


def roll_up(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, worst: number of findings and the highest severity."""
    worst = F.max(rank(F.col("severity")))
    names = F.create_map(*(x for name, place in SEVERITIES.items() for x in (F.lit(place), F.lit(name))))
    return findings.groupBy(*keys).agg(F.count("*").alias("n"), worst.alias("_w")).select(*keys, "n", names[F.col("_w")].alias("worst"))


@dataclass(frozen=True)
class Staged:
    """Fires where each of ``needs`` has one of its findings present and none of ``blocked`` is; ids emitted by later rules are not seen.

    A rule that isn't ``shown`` adds its id for later rules only.
    """

    id: str
    needs: tuple[tuple[str, ...], ...]
    otherwise: str
    levels: tuple[tuple[str, tuple[str, ...]], ...] = ()
    blocked: tuple[str, ...] = ()
    shown: bool = True


#: Bits of a word that are used.
WORD = 63


def _mask(bits: Iterable[int]) -> dict[int, int]:
    """Bits as whole numbers, by word."""
    words: dict[int, int] = {}
    for n in bits:
        words[n // WORD] = words.get(n // WORD, 0) | 1 << n % WORD
    return words


def _holds(bits: Iterable[int]) -> Column:
    """Whether the set in the columns _w0, _w1 ... holds any of the bits."""
    tests = (F.col(f"_w{k}").bitwiseAND(F.lit(mask).cast("long")) != 0 for k, mask in _mask(bits).items())
    return reduce(Column.__or__, tests, F.lit(False))


def correlate(findings: DataFrame, keys: list[str], rules: Sequence[Staged]) -> DataFrame:
    """keys, finding_id, severity, position: staged rules over each key's set of finding ids, in order, each seeing what earlier ones emitted.

    The set is some words with a bit for each id that rules speak of and for each severity that a rule may emit. A key's findings are joined by
    ``bit_or``, in part before the one shuffle, and each rule is a projection that adds a bit where it fires, so a key costs some tests of whole
    numbers. The plan grows with the rules in proportion. ``position`` counts the rules that are shown.
    """
    spoken = list(dict.fromkeys(x for rule in rules for group in (*rule.needs, rule.blocked, *(ids for _, ids in rule.levels)) for x in group))
    bits = {x: [n] for n, x in enumerate(spoken)}
    chosen, options, end = [], [], len(spoken)
    for rule in rules:
        names = [*(name for name, _ in rule.levels), rule.otherwise]
        own = range(end, end := end + len(names))
        bits.setdefault(rule.id, []).extend(own)
        chosen.append(own)
        options.append(list(zip(names, own, strict=True)) if rule.shown else [])
    words = range(-(-end // WORD))

    of = lambda n, k: F.lit(1 << n % WORD if n // WORD == k else 0).cast("long")
    known = F.array(*(F.struct(F.lit(x).alias("finding_id"), *(of(n, k).alias(f"_w{k}") for k in words)) for n, x in enumerate(spoken)))
    marked = findings.where(F.col("finding_id").isNotNull()).join(F.broadcast(findings.sparkSession.range(1).select(F.inline(known))), "finding_id", "left")
    state = marked.groupBy(*keys).agg(*(F.coalesce(F.bit_or(f"_w{k}"), F.lit(0)).alias(f"_w{k}") for k in words))
    any_of = lambda ids: _holds(n for x in ids for n in bits[x])
    for rule, own in zip(rules, chosen, strict=True):
        fires = reduce(Column.__and__, map(any_of, rule.needs), ~any_of(rule.blocked))
        for k in _mask(own):
            emitted = of(own[-1], k)
            for n, (_, ids) in reversed(list(zip(own, rule.levels, strict=False))):
                emitted = F.when(any_of(ids), of(n, k)).otherwise(emitted)
            state = state.withColumn(f"_n{k}", F.when(fires, F.col(f"_w{k}").bitwiseOR(emitted)).otherwise(F.col(f"_w{k}")))
        state = state.select(*keys, *(F.col(f"_n{k}" if k in _mask(own) else f"_w{k}").alias(f"_w{k}") for k in words))
    shown = [(rule, option) for rule, option in zip(rules, options, strict=True) if rule.shown]
    emitted = [F.when(_holds([n]), F.struct(F.lit(rule.id).alias("finding_id"), F.lit(name).alias("severity"), F.lit(place).alias("position"))) for place, (rule, option) in enumerate(shown) for name, n in option]
    found = F.explode_outer(F.array_compact(F.array(*emitted))).alias("f")  # outer, or the optimizer tests every rule again
    return state.select(*keys, found).where("f IS NOT NULL").select(*keys, "f.*")
