"""How queries are registered: each is a function of (spark, sf_dir), with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def cents(column: str):
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us, user_id, event_type, value, cents, props."""
    return table(spark, sf_dir, "events").select("event_id", micros("ts").alias("us"), "user_id", "event_type", "value", cents("value").alias("cents"), "props")


#: The same in SQL.
EVENTS = "(SELECT event_id, epoch_us(ts)::BIGINT AS us, user_id, event_type, value, round(value * 100)::BIGINT AS cents, props FROM events) e"
