"""An extension: pauses of growing GC logs as a stream. Batch reading is in ``heapstone.sources``; parsing is the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapstone.parse.gc import cause, pause_type

_PAUSE = r"\b(Pause .*?)\s*(?:\d+[BKMG]->\d+[BKMG]\(\d+[BKMG]\)\s*)?(\d+\.\d+)ms\s*$"


def pause_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """event_ts, event, cause, pause_type, pause_ms of each pause line in new files of a folder (unified logs with wall clocks)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    line = F.col("value")
    event = F.trim(F.regexp_extract(line, _PAUSE, 1))
    stamp = F.try_to_timestamp(F.regexp_extract(line, r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}[+-]\d{4})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSxx"))
    return lines.where(line.rlike(_PAUSE)).select(stamp.alias("event_ts"), event.alias("event"), cause(event).alias("cause"), pause_type(event).alias("pause_type"), F.regexp_extract(line, _PAUSE, 2).cast("double").alias("pause_ms"))


def pause_load(pauses: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, total and maximum by pause type and window; pauses later than ``late`` are left out."""
    return pauses.withWatermark("event_ts", late).groupBy(F.window("event_ts", width), "pause_type").agg(F.count("*").alias("n"), F.sum("pause_ms").alias("total_ms"), F.max("pause_ms").alias("max_ms"))
