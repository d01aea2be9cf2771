"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JVM descriptors of primitive arrays.
ARRAYS = {"[B": "byte[]", "[C": "char[]", "[I": "int[]", "[J": "long[]", "[D": "double[]", "[F": "float[]", "[S": "short[]", "[Z": "boolean[]"}


def number(text: Column, pattern: str, group: int = 1, kind: str = "double") -> Column:
    """A number taken from text by a pattern; null where it isn't found."""
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Text taken by a pattern; null where nothing is found."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def size_bytes(amount: Column, unit: Column) -> Column:
    """Bytes of an amount with a unit of K, M, G or T (1024 each); no unit is bytes. Half up."""
    power = F.coalesce(F.array_position(F.array(*map(F.lit, "KMGT")), F.upper(unit)), F.lit(0))
    return F.floor(amount * F.pow(F.lit(1024.0), power) + 0.5).cast("long")


def slug(text: Column) -> Column:
    """Lower case with single dashes for everything else than letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def package(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def readable_class(name: Column) -> Column:
    """Array descriptors as written in source: ``[Lx;`` is ``x[]``; others stay."""
    plain = F.when(name.rlike(r"^\[L.*;$"), F.concat(F.regexp_extract(name, r"^\[L(.*);$", 1), F.lit("[]"))).otherwise(name)
    for raw, shown in ARRAYS.items():
        plain = F.when(name == raw, F.lit(shown)).otherwise(plain)
    return plain


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three being dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
