"""Queries of the text statistics."""

from __future__ import annotations

from sourceloom.llm.quality import document_statistics, language_references, not_prose
from sourceloom.session import durable, table


def p9_found(spark, sf_dir):
    return not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).select("doc_id").distinct()


def p9_statistics(spark, sf_dir):
    return document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_references(spark, sf_dir):
    return language_references(durable(document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))))


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_references": p9_references}
ORACLES: dict[str, str] = {}
