"""Run traces as a stream, an addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.operators.traces import TRACE, summarise


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as they are written to a folder, with ``at``, their time."""
    return spark.readStream.schema(TRACE).json(folder).withColumn("at", F.to_timestamp("timestamp"))


def windowed_summary(traces: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The summary per window of time; rows later than the watermark are left
    to the batch summary."""
    marked = traces.withWatermark("at", late).withColumn("window", F.window("at", size))
    return summarise(marked, ["window"])


def session_summary(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id, value) per user and session: count and sum."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
