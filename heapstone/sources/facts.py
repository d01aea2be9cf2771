"""Facts of any kind of artifact in one table: the summary row of each as a VARIANT, so that kinds with different columns are saved and read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "artifact_id"


def canonical(summary: DataFrame, kind: str, omit_empty: bool = False) -> DataFrame:
    """artifact_id, kind, facts: all other columns of a summary by name; nulls stay nulls, or are left out with ``omit_empty``.

    Numbers that aren't finite are texts in JSON and come back as such; times are texts in ISO format.
    """
    fields = F.struct(*(F.col(c) for c in summary.columns if c != KEY))
    return summary.select(KEY, F.lit(kind).alias("kind"), F.parse_json(F.to_json(fields, {"ignoreNullFields": str(omit_empty).lower()})).alias("facts"))


def save(facts: DataFrame, path: str) -> None:
    """Parquet in folders by kind, so that a kind is read by itself."""
    facts.write.mode("append").partitionBy("kind").parquet(path)


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    found = spark.read.parquet(path).select(KEY, "kind", "facts")
    return found.where(F.col("kind") == kind) if kind else found


def present(facts: DataFrame) -> DataFrame:
    """kind, field, type, n: which fields the facts of each kind hold, of what types, and in how many artifacts they aren't null."""
    cells = facts.select("kind", F.explode(F.from_json(F.to_json("facts"), "map<string,string>")).alias("field", "value"), "facts").where("value IS NOT NULL")
    typed = cells.select("kind", "field", F.schema_of_variant(F.try_variant_get("facts", F.concat(F.lit("$['"), "field", F.lit("']")), "variant")).alias("type"))
    return typed.groupBy("kind", "field", "type").agg(F.count("*").alias("n"))


def typed(facts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """artifact_id and the named fields under their types; null where a field is missing or isn't of its type."""
    return facts.select(KEY, *(F.try_variant_get("facts", f"$['{name}']", kind).alias(name) for name, kind in columns.items()))
