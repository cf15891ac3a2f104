"""Queries of the window filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.llm.packing import CAPACITY, fill_windows
from sourceloom.session import table


def p8_windows(spark, sf_dir):
    return fill_windows(table(spark, sf_dir, "documents"))


def p8_unused(spark, sf_dir):
    """How much room the windows leave unused."""
    used = fill_windows(table(spark, sf_dir, "documents")).groupBy("window_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("used").alias("n_tokens"), (1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("share_unused"), F.max("used").alias("fullest")
    )


QUERIES = {"p8_windows": p8_windows, "p8_unused": p8_unused}
ORACLES: dict[str, str] = {}
