"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one Parquet table (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads rows over the cores when the scan gives fewer partitions than
    there are cores, as with one small file. Large inputs already come in many
    splits and aren't shuffled. For scans and what is narrow on them: asking a
    plan with shuffles for its partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives the loss of
    an executor. The folder is the one the cluster names in
    spark.checkpoint.dir; a temporary one is set only where none is named."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sourceloom-checkpoint-"))
    return df.checkpoint()


def under(df: DataFrame, limit: int) -> bool:
    """Whether df has at most so many rows; reads no more than it needs."""
    return df.limit(limit + 1).count() <= limit


def present(col) -> "F.Column":
    """True where a string column is neither null nor empty."""
    return col.isNotNull() & (F.length(col) > 0)
