"""Redaction with stable tokens: command lines, secrets in environment assignments, paths, addresses and host names.

The same value has the same token throughout a report (``redact_report``) or a text (``redact``). A text is marked first, step by step, with
numbered placeholders that no later step can read; the values behind them get their tokens afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapstone.sources.stored import stored

#: Parts of names of variables whose value is redacted, and beginnings of such names.
SENSITIVE = ("TOKEN", "SECRET", "PASSWORD", "PASS", "PWD", "KEY", "CREDENTIAL", "COOKIE", "SESSION", "AUTH", "HOME", "USER", "USERNAME", "LOGNAME", "HOST", "PATH", "JAVA", "KUBECONFIG")
SENSITIVE_STARTS = ("OCI_", "AWS_", "AZURE_", "GCP_")
#: Endings that make a dotted name a file, unless it has three dots or more; parts of names of language models.
FILE_ENDINGS = ("cfg", "conf", "csv", "gz", "histogram", "html", "jar", "java", "json", "log", "md", "out", "properties", "sh", "so", "tar", "tmp", "txt", "war", "xml", "yaml", "yml")
MODELS = ("grok", "gpt", "claude", "gemini", "llama", "mistral", "qwen", "deepseek", "phi")


def sensitive_key(key: Column) -> Column:
    """Whether a variable's name tells that its value is to be hidden."""
    upper = F.upper(key)
    return upper.rlike("|".join(SENSITIVE)) | upper.rlike(f"^(?:{'|'.join(SENSITIVE_STARTS)})")


def is_host(name: Column) -> Column:
    """Whether a dotted name is a host: not a number, a class, a template, a version, a model or a file."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    other = name.rlike(r"^\d+(?:\.\d+)+[a-zA-Z%]*$") | name.rlike(r"^(?:[a-z_][a-z0-9_]*\.)+[A-Z][A-Za-z0-9_$-]*$") | name.rlike(r"^[A-Za-z][A-Za-z0-9-]*\.[0-9]+$") | name.rlike(r"^[A-Z][A-Za-z0-9_$-]*\.[a-z][A-Za-z0-9_$-]*$") | F.lower(name).rlike("|".join(MODELS))
    file = F.lower(name).rlike(rf"\.(?:{'|'.join(FILE_ENDINGS)})$") & (dots < 3)
    return name.rlike("[A-Za-z]") & ~F.lower(name).startswith("redacted-") & ~other & ~file


@dataclass(frozen=True)
class Step:
    """A kind of value: its token's name, what finds it (groups 1 and 2, if ``kept``, stay before the token), a cheap test, a test of what was found."""

    name: str
    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    kept: bool = False
    test: Callable[[Column, Column], Column] | None = None


#: Patterns, in the order they run.
STEPS = (
    Step("command", "command", r"(?im)\b(java command|java_command|command line|sun\.java\.command|launcher command|vm arguments)\b(\s*[:=]\s*)([^\n]+)", lambda t: F.lower(t).rlike("command|arguments"), True),
    Step("env", "env", r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9_]{2,})(\s*=\s*)([^\s,;]+)", lambda t: t.contains("="), True, lambda key, _: sensitive_key(key)),
    Step("path", "path", r"(?<![A-Za-z0-9])/(?:[^\s/]+/)*[^\s)\],;:]+", lambda t: t.contains("/")),
    Step("windows-path", "path", r"(?<![A-Za-z0-9])[A-Za-z]:\\(?:[^\s\\]+\\)*[^\s)\],;:]+", lambda t: t.contains(":\\")),
    Step("ip", "host", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", lambda t: t.contains(".")),
    Step("host", "host", r"\b[a-zA-Z0-9][a-zA-Z0-9-]*(?:\.[a-zA-Z0-9-]+){1,}\b", lambda t: t.contains("."), False, lambda _, value: is_host(value)),
)
NAMES = tuple(step.name for step in STEPS)
_VALUES = "array<struct<kind:string,value:string>>"


def _placeholder(number: Column) -> Column:
    return F.concat(F.lit(")\ue000"), number.cast("string"), F.lit("\ue001)"))


def _marked(step: Step) -> Callable[[Column], Column]:
    """One step over a state of text and values: both after it. Names in lambdas are bound once, so nothing is evaluated twice."""

    def run(state: Column) -> Column:
        text, values = state["text"], state["values"]
        every = lambda group: F.regexp_extract_all(text, F.lit(step.pattern), F.lit(group))
        first, second, last = (every(1), every(2), every(3)) if step.kept else (every(0),) * 3
        rows = F.arrays_zip(every(0).alias("whole"), first.alias("a"), second.alias("b"), last.alias("c"))
        before = F.size(values)

        def shown(x: Column, i: Column) -> Column:
            new = _placeholder(before + i)
            full = F.concat(x["a"], x["b"], new) if step.kept else new
            return F.when(step.test(x["a"], x["c"]), full).otherwise(x["whole"]) if step.test else full

        joined = _interleaved(F.split(text, step.pattern, -1), F.transform(rows, shown))
        value = lambda x: F.concat(x["a"], F.lit("="), x["c"]) if step.name == "env" else x["c"]
        found = F.transform(rows, lambda x: F.struct(F.lit(step.kind).alias("kind"), value(x).alias("value")))
        after = F.struct(joined.alias("text"), F.concat(values, found).cast(_VALUES).alias("values"))
        return F.when(step.hint(text), after).otherwise(state)

    return run


def marked(text: Column, names: tuple[str, ...] = NAMES) -> Column:
    """text with placeholders, and the values behind them by number: those of every step, redacted or not."""
    state = F.when(text.isNotNull(), F.struct(text.alias("text"), F.expr(f"cast(array() AS {_VALUES})").alias("values")))
    for step in STEPS:
        if step.name in names:
            state = F.transform(F.array(state), _marked(step))[0]
    return state


def token(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("[redacted-"), kind, F.lit("-"), number.cast("string"), F.lit("]"))


def _interleaved(parts: Column, between: Column) -> Column:
    """The parts of a text with what stands between them, of which there is one less."""
    return F.array_join(F.zip_with(parts, F.concat(F.array(F.lit("")), between), lambda p, x: F.concat(F.coalesce(x, F.lit("")), F.coalesce(p, F.lit("")))), "")


#: Placeholders in a marked text.
_PLACE = r"\)\ue000(\d{1,9})\ue001\)"


def _placed(state: Column) -> Column:
    """Structs of number, kind and value of the placeholders that stand in the text, in its order. Kind is null for one that a text came with."""
    numbers = F.transform(F.regexp_extract_all(state["text"], F.lit(_PLACE), F.lit(1)), lambda n: n.cast("int"))
    return F.transform(numbers, lambda n: F.struct(n.alias("n"), F.get(state["values"], n)["kind"].alias("kind"), F.get(state["values"], n)["value"].alias("value")))


def _resolved(text: Column, tokens: Column) -> Column:
    """A marked text with one token for each placeholder in its order: cut once at all of them and joined again."""
    return _interleaved(F.split(text, _PLACE, -1), tokens)


def redact(text: Column, names: tuple[str, ...] = NAMES) -> Column:
    """One text by itself: values are numbered by kind in the order they were found. Null stays null.

    Each value is looked up among the distinct ones of its text, so texts with tens of thousands of values are for ``redact_texts``.
    """
    kinds = tuple(dict.fromkeys(step.kind for step in STEPS))

    def run(state: Column) -> Column:
        def resolve(placed: Column) -> Column:
            ordered = F.array_sort(placed)
            distinct = lambda kind: F.array_distinct(F.transform(F.filter(ordered, lambda y: y["kind"] == kind), lambda y: y["value"]))
            lists = F.struct(*(distinct(k).alias(k) for k in kinds))

            def numbered(of: Column) -> Column:
                number = lambda x: F.coalesce(*(F.when(x["kind"] == k, F.array_position(of[k], x["value"])) for k in kinds))
                return _resolved(state["text"], F.transform(placed, lambda x: F.coalesce(token(x["kind"], number(x)), _placeholder(x["n"]))))

            return F.transform(F.array(lists), numbered)[0]

        return F.transform(F.array(_placed(state)), resolve)[0]

    return F.transform(F.array(marked(text, names)), lambda s: F.when(s.isNotNull(), run(s)))[0]


def redact_report(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """``rows`` with the text column redacted: a value has one token in all rows of a report (``keys``), numbered by kind from where it first stands.

    ``keys`` and ``order`` name a row. Marked texts are stored once. A table of a report's distinct values is numbered and joined back, a row's
    tokens are sorted into its text's order, so the work follows the number of values, also within one text.
    """
    made = stored(rows.withColumn("_m", marked(F.col(text))), "redaction")
    cells = made.where("size(_m.values) > 0").select(*keys, order, F.explode(F.transform(_placed(F.col("_m")), lambda x, i: F.struct(i.alias("at"), x["n"].alias("n"), x["kind"].alias("kind"), x["value"].alias("value")))).alias("_u"))
    found = cells.select(*keys, order, F.col("_u.at").alias("_at"), F.col("_u.n").alias("_n"), F.col("_u.kind").alias("_kind"), F.col("_u.value").alias("_value"))
    firsts = found.where("_kind IS NOT NULL").groupBy(*keys, "_kind", "_value").agg(F.min(F.struct(order, "_n")).alias("_first"))
    named = firsts.withColumn("_t", token(F.col("_kind"), F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy("_first")))).drop("_first")
    given = found.join(named, [*keys, "_kind", "_value"], "left").withColumn("_t", F.coalesce("_t", _placeholder(F.col("_n"))))
    tokens = given.groupBy(*keys, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]).alias("_tokens"))
    joined = made.join(tokens, [*keys, order], "left")
    done = F.when(F.col("_tokens").isNull(), F.col("_m.text")).otherwise(_resolved(F.col("_m.text"), F.col("_tokens")))
    return joined.withColumn(text, done).select(*rows.columns)


def redact_texts(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """As ``redact`` for each row (``keys`` name it), however many values its text has."""
    return redact_report(rows.withColumn("_order", F.lit(0)), keys, "_order", text).drop("_order")
