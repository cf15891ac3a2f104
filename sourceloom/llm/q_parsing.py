"""Queries of the parse check."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.llm.parsing import broken_symbols, parse_check, parse_rates
from sourceloom.session import table


def p4_found(spark, sf_dir):
    return parse_check(table(spark, sf_dir, "sources")).where(~F.col("parses")).select("file_id").distinct()


def p4_rates(spark, sf_dir):
    return parse_rates(table(spark, sf_dir, "sources"), table(spark, sf_dir, "files"))


def p4_symbols(spark, sf_dir):
    return broken_symbols(table(spark, sf_dir, "sources"), table(spark, sf_dir, "symbols"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_symbols": p4_symbols}
ORACLES: dict[str, str] = {}
