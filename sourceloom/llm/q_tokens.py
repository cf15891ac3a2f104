"""Queries of the tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.llm.tokenization import token_counts, token_ids
from sourceloom.session import table


def p7_ids(spark, sf_dir):
    return token_ids(table(spark, sf_dir, "documents"))


def p7_tokens_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = token_counts(docs)
    return (
        docs.select("doc_id", "source")
        .join(sizes, "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))
    )


QUERIES = {"p7_ids": p7_ids, "p7_tokens_per_source": p7_tokens_per_source}
ORACLES: dict[str, str] = {}
