"""Incremental ingestion: a landing folder of commands, each applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def commands(spark: SparkSession, path: str, schema: StructType, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Commands that land as Parquet; an event_key counts once within the time that rows may be late."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, late).dropDuplicatesWithinWatermark(["event_key"])


def counts(stream: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Actions by window of time and kind."""
    return stream.groupBy(F.window(at, window), "db_action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "db_action", "n")


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has landed so far to the event log, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
