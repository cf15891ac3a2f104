"""Queries of the splitter."""

from __future__ import annotations

from sourceloom.llm.splitting import split_items, unit_boundaries
from sourceloom.session import table


def p3_found(spark, sf_dir):
    return unit_boundaries(table(spark, sf_dir, "chunks"))


def p3_pieces(spark, sf_dir):
    return split_items(table(spark, sf_dir, "chunks"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES: dict[str, str] = {}
