"""Ranked retrieval: BM25, symbol hits, their fusion, and workspaces."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions.text import query_tokens
from sourceloom.operators.index import Index

#: The constants of the ranking function and of the fusion.
K1, B = 1.5, 0.75
BM25_WEIGHT, SYMBOL_WEIGHT = 0.6, 0.4


def query_terms(spark, query: str) -> DataFrame:
    """Terms of a query: (term, mult, first_pos). A query is typed by a user;
    its size is bounded."""
    bag = query_tokens(query)
    counted = Counter(bag)
    return spark.createDataFrame([(t, n, bag.index(t)) for t, n in counted.items()], "term string, mult int, first_pos int")


def bm25_scores(index: Index, query: str) -> DataFrame:
    """Scores above 0 of all documents: (project, doc_key, bm25). Repeated
    query terms count again. Only postings of the query's terms are read; a
    query without words gives no row."""
    spark = index.postings.sparkSession
    terms = F.broadcast(query_terms(spark, query))
    hits = index.postings.join(terms, "term")
    stats = index.term_stats.join(F.broadcast(query_terms(spark, query).select("term")), "term").join(index.sizes, "project")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weighted = stats.withColumn("idf", idf).select("project", "term", "idf", "avg_dl")
    joined = hits.join(weighted, ["project", "term"])
    tf = F.col("tf").cast("double")
    norm = F.when(F.col("avg_dl") > 0, tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))).otherwise(tf + K1)
    part = F.col("mult") * F.col("idf") * (tf * (K1 + 1)) / norm
    summed = joined.groupBy("project", "doc_key").agg(F.collect_list(F.struct("first_pos", part.alias("part"))).alias("parts"))
    total = F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda acc, x: acc + x["part"])
    return summed.select("project", "doc_key", total.alias("bm25")).where("bm25 > 0")


def top_bm25(index: Index, query: str, top_k: int = 20) -> DataFrame:
    """The top_k documents of each project by BM25, ties by doc_key, with
    ``rank`` from 1."""
    w = Window.partitionBy("project").orderBy(F.desc("bm25"), "doc_key")
    return bm25_scores(index, query).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def symbol_hits(symbol_docs: DataFrame, query: str) -> DataFrame:
    """How often query terms name a symbol of a document: (project, doc_key,
    hits, first_pos)."""
    terms = F.broadcast(query_terms(symbol_docs.sparkSession, query))
    joined = symbol_docs.distinct().join(terms, F.col("name_lower") == F.col("term"))
    return joined.groupBy("project", "doc_key").agg(F.sum("mult").alias("hits"), F.min("first_pos").alias("first_pos"))


def fuse(bm25_top: DataFrame, hits: DataFrame, bm25_weight: float = BM25_WEIGHT, symbol_weight: float = SYMBOL_WEIGHT) -> DataFrame:
    """Both scores, each divided by its project's largest, weighted and added;
    a document may have either alone."""
    both = bm25_top.select("project", "doc_key", "bm25", "rank").join(hits, ["project", "doc_key"], "full_outer")
    best = both.groupBy("project").agg(F.max("bm25").alias("max_bm25"), F.max("hits").alias("max_hits"))
    joined = both.join(best, "project")
    score = F.coalesce(F.col("bm25") / F.col("max_bm25") * bm25_weight, F.lit(0.0)) + F.coalesce(F.col("hits") / F.col("max_hits") * symbol_weight, F.lit(0.0))
    return joined.withColumn("score", score)


def search(index: Index, symbol_docs: DataFrame, query: str, top_k: int = 10, bm25_weight: float = BM25_WEIGHT, symbol_weight: float = SYMBOL_WEIGHT) -> DataFrame:
    """The top_k documents of every project: (project, doc_key, score,
    final_rank). Ties: BM25 rank (without one last), then the first query word
    that hit, then doc_key. The BM25 side keeps 3 * top_k candidates."""
    fused = fuse(top_bm25(index, query, 3 * top_k), symbol_hits(symbol_docs, query), bm25_weight, symbol_weight)
    w = Window.partitionBy("project").orderBy(F.desc("score"), F.asc_nulls_last("rank"), F.asc_nulls_last("first_pos"), "doc_key")
    return fused.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= top_k).select("project", "doc_key", "score", "final_rank")


def search_workspace(index: Index, symbol_docs: DataFrame, query: str, top_k: int = 10, **weights) -> DataFrame:
    """The best top_k over all projects, each with its own statistics and
    normalisation; ties by project and rank. Scores are compared as shown, with
    4 decimals."""
    found = search(index, symbol_docs, query, top_k, **weights)
    shown = F.bround(F.col("score"), 4)
    return found.withColumn("shown", shown).orderBy(F.desc("shown"), "project", "final_rank").limit(top_k)
