"""Overlapping line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import lines, source_type


def line_windows(files: DataFrame, size: int = 40, overlap: int = 10, keep: tuple[str, ...] = ("project", "path"), text_col: str = "content") -> DataFrame:
    """Windows of ``size`` lines that share ``overlap`` lines with the next.

    Gives the kept columns, ``window_no``, ``start_line``, ``end_line`` (from
    1), ``content`` and ``source_type`` (by path, if kept). A text that fits is
    one window, an empty or null one none; windows stop once the end is
    reached. One narrow stage: no row meets another.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    step = size - overlap
    base = files.select(*keep, lines(F.col(text_col)).alias("__lines")).where(F.size("__lines") > 0)
    last = F.greatest(F.ceil((F.size("__lines") - size) / step), F.lit(0)).cast("int")
    out = base.withColumn("window_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("window_no") * step
    out = out.withColumn("__part", F.slice("__lines", start + 1, F.lit(size)))
    columns = [*keep, "window_no", (start + 1).cast("int").alias("start_line"), (start + F.size("__part")).cast("int").alias("end_line"), F.array_join("__part", "\n").alias("content")]
    if "path" in keep:
        columns.append(source_type(F.col("path")).alias("source_type"))
    return out.select(*columns)
