"""Run traces: records of pipeline runs and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = ("timestamp", "task", "repo")
_LONGS = ("chunks_retrieved", "chunks_total_tokens", "chunks_after_compression", "compressed_tokens", "project_context_tokens", "spec_tokens", "repo_map_tokens", "total_input_tokens", "packed_tokens", "token_budget", "over_budget")
_DOUBLES = ("compression_ratio", "index_time_s", "search_time_s", "compress_time_s", "pack_time_s", "total_time_s")

TRACE = T.StructType([T.StructField(n, T.StringType()) for n in _STRINGS] + [T.StructField(n, T.LongType()) for n in _LONGS] + [T.StructField(n, T.DoubleType()) for n in _DOUBLES])

#: Rows per day up to which files are read, newest first.
ROWS_A_DAY = 50


def load_traces(spark: SparkSession, folder: str, days: int = 7) -> DataFrame:
    """Traces of the JSONL files in a folder, newest file first.

    A line that is no record of known fields ends its file, earlier lines
    stay; a file is read if the files before it, broken ones aside, have fewer
    than days * ROWS_A_DAY rows together.
    """
    raw = spark.read.text(f"{folder}/pipeline-*.jsonl", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("value").alias("body"))
    rows = raw.select("file", F.posexplode(F.split("body", "\r\n|[\n\r]")).alias("ln", "raw")).where(F.trim("raw") != "")
    known = F.array(*[F.lit(n) for n in TRACE.names])
    keys = F.json_object_keys("raw")
    good = F.col("raw").rlike(r"^\s*\{") & keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0)
    marked = rows.withColumn("bad", ~F.coalesce(good, F.lit(False)))
    first_bad = F.min(F.when(F.col("bad"), F.col("ln"))).over(Window.partitionBy("file"))
    kept = marked.withColumn("stop", first_bad).where(F.col("stop").isNull() | (F.col("ln") < F.col("stop")))
    per_file = marked.withColumn("stop", first_bad).groupBy("file").agg(F.sum(F.when(F.col("stop").isNull() | (F.col("ln") < F.col("stop")), 1).otherwise(0)).alias("n"), F.bool_or("bad").alias("broken"))
    newest = Window.orderBy(F.desc("file"))
    so_far = per_file.withColumn("total", F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.when(~F.col("broken") & (F.col("total") >= days * ROWS_A_DAY), 1).otherwise(0)
    wanted = so_far.withColumn("done", F.coalesce(F.max(full).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("done = 0").select("file")
    parsed = kept.join(F.broadcast(wanted), "file").withColumn("t", F.from_json("raw", TRACE))
    return parsed.select("file", "ln", "t.*")


def save_trace(trace: DataFrame, folder: str) -> None:
    """Appends traces as JSON, for readers that take a folder."""
    trace.write.mode("append").json(folder)


def summarise(traces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of runs, over all or by columns: the ratio is one of sums, 0
    where nothing was retrieved."""
    grouped = traces.groupBy(*by) if by else traces
    n = F.count(F.lit(1))
    ratio = F.coalesce(F.try_divide(F.sum("compressed_tokens"), F.sum("chunks_total_tokens")), F.lit(0.0))
    return grouped.agg(
        n.alias("total_runs"), F.sum("total_input_tokens").alias("total_input_tokens"), F.sum("packed_tokens").alias("total_packed_tokens"),
        (F.sum("total_input_tokens") - F.sum("packed_tokens")).alias("total_tokens_saved"), F.bround(ratio, 3).alias("avg_compression_ratio"),
        F.bround(F.try_divide(F.sum("packed_tokens"), n), 0).cast("bigint").alias("avg_packed_tokens"), F.bround(F.try_divide(F.sum("total_time_s"), n), 2).alias("avg_time_s"), F.bround(F.sum("total_time_s"), 2).alias("total_time_s"),
    )
