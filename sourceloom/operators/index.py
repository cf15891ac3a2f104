"""The search index: postings, document frequencies and sizes as tables.

Every table is keyed by project, so that one job indexes a whole workspace and
each project keeps its own statistics. ``doc_key`` orders the documents of a
project and breaks ties in rankings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.text import query_tokens, tokens
from sourceloom.session import durable


@dataclass
class Index:
    """Tables of an index: documents (project, doc_key, ...), postings
    (project, doc_key, term, tf, dl), term_stats (project, term, df), sizes
    (project, n, avg_dl)."""

    documents: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    sizes: DataFrame

    def save(self, folder: str) -> None:
        """Writes the tables as Parquet, postings by project."""
        self.documents.write.mode("overwrite").parquet(f"{folder}/documents")
        self.postings.write.mode("overwrite").partitionBy("project").parquet(f"{folder}/postings")
        self.term_stats.write.mode("overwrite").parquet(f"{folder}/term_stats")
        self.sizes.write.mode("overwrite").parquet(f"{folder}/sizes")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        """Reads a saved index."""
        return Index(*[spark.read.parquet(f"{folder}/{t}") for t in ("documents", "postings", "term_stats", "sizes")])


def build_index(documents: DataFrame, text_col: str = "content") -> Index:
    """Indexes documents with ``project`` and ``doc_key``.

    Documents without any token count in the sizes. Terms are counted per
    document before anything is shuffled.
    """
    worded = documents.select("project", "doc_key", F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    sized = worded.withColumn("dl", F.size("t"))
    exploded = sized.select("project", "doc_key", "dl", F.explode("t").alias("term"))
    postings = exploded.groupBy("project", "doc_key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    term_stats = postings.groupBy("project", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = sized.groupBy("project").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl"))
    return Index(documents, postings, term_stats, sizes)


def _equals(term: str):
    return lambda x: x == term


def query_index(documents: DataFrame, query: str, text_col: str = "content") -> Index:
    """An index of the terms of one query only, from one pass over the texts:
    per document its length and how often each term occurs. That much is
    written to a checkpoint; nothing else is shuffled but counts."""
    terms = sorted(set(query_tokens(query)))
    worded = documents.select("project", "doc_key", F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
    counts = F.array(*[F.struct(F.lit(q).alias("term"), F.size(F.filter("t", _equals(q))).cast("bigint").alias("tf")) for q in terms])
    base = durable(worded.select("project", "doc_key", F.size("t").alias("dl"), counts.alias("c"))) if terms else worded.select("project", "doc_key", F.size("t").alias("dl"), F.lit(None).cast("array<struct<term:string,tf:bigint>>").alias("c"))
    postings = base.select("project", "doc_key", "dl", F.inline(F.filter("c", lambda x: x["tf"] > 0)))
    term_stats = postings.groupBy("project", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = base.groupBy("project").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl"))
    return Index(documents, postings, term_stats, sizes)


def symbol_windows(windows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each window with each symbol whose line lies in it: (project, doc_key,
    name_lower), distinct. A range join within the equal path, which the window
    length turns into an equality: a line meets only the windows whose bucket
    it can be in."""
    joined = _in_windows(windows, symbols)
    return joined.select("project", "doc_key", F.lower("name").alias("name_lower")).distinct()


def _in_windows(windows: DataFrame, symbols: DataFrame, bucket: int = 256) -> DataFrame:
    spans = windows.select("project", "path", "doc_key", "start_line", "end_line").withColumn(
        "b", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket)))
    )
    points = symbols.withColumn("b", F.floor(F.col("line") / bucket))
    return spans.join(points, ["project", "path", "b"]).where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))).drop("b")


def window_symbols(windows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of the symbols in each window in file order, children as
    ``Parent.child``: (project, doc_key, symbols). ``parent_ord`` is null at
    top level and else the ``ord`` of the parent in the same file."""
    parents = symbols.where("parent_ord IS NULL").select("project", "path", F.col("ord").alias("parent_ord"), F.col("name").alias("parent_name"))
    named = symbols.join(parents, ["project", "path", "parent_ord"], "left").withColumn(
        "shown", F.when(F.col("parent_ord").isNull(), F.col("name")).otherwise(F.concat_ws(".", "parent_name", "name"))
    )
    return _in_windows(windows, named).groupBy("project", "doc_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "shown"))), lambda s: s["shown"]).alias("symbols")
    )
