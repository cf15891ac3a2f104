"""Queries of the search for files that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.llm.handwritten import not_handwritten
from sourceloom.llm.parsing import clean_language
from sourceloom.session import table


def p6_found(spark, sf_dir):
    return not_handwritten(table(spark, sf_dir, "sources")).select("file_id").distinct()


def p6_reasons(spark, sf_dir):
    return not_handwritten(table(spark, sf_dir, "sources"))


def p6_handwritten_lines(spark, sf_dir):
    """Per project and language the scanned files and lines that remain."""
    files = table(spark, sf_dir, "files").distinct()
    latest = files.groupBy("file_id").agg(F.max_by(F.struct("project", "path", "language", "lines"), F.struct("scanned_at", "lines")).alias("f")).select("file_id", "f.*")
    left = latest.join(p6_found(spark, sf_dir), "file_id", "left_anti")
    return left.groupBy("project", clean_language(F.col("language"), F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("n_lines"))


QUERIES = {"p6_found": p6_found, "p6_reasons": p6_reasons, "p6_handwritten_lines": p6_handwritten_lines}
ORACLES: dict[str, str] = {}
