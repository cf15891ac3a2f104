"""Query-aware compression of retrieved chunks, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions.text import identifiers, lines, query_identifiers

#: Lines worth keeping, and lines that may go first.
KEEP_LINES = [
    r"(?i)^\s*(def |class |async def )",
    r"^\s*(import |from .+ import )",
    r"^\s*(raise |except |finally:)",
    r"^\s*(return |yield )",
    r"^\s*@",
    r"^\s*(if __name__|assert )",
    r"(?i)#\s*(TODO|FIXME|HACK|BUG|XXX|NOTE)",
    r"^\s*(interface |struct |enum |type |func |fn |pub fn )",
]
DROP_LINES = [
    r"^\s*#(?!\s*(TODO|FIXME|HACK|BUG|XXX|NOTE))",
    r"^\s*//(?!\s*(TODO|FIXME|HACK|BUG|XXX|NOTE))",
    r'^\s*"""',
    r"^\s*'''",
    r"^\s*(pass|\.\.\.)\s*$",
    r"^\s*$",
    r"^\s*(logger\.|logging\.|log\.)",
    r"^\s*print\(",
]

#: Chunks of up to so many lines stay as they are.
SHORT_CHUNK = 5


def _any(line: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(p)
    return out


def line_relevance(line: Column, query: str, structural_bonus: float = 0.3, query_match_bonus: float = 0.4) -> Column:
    """0.3 for a line of structure, up to 0.4 for shared identifiers, less 0.2
    for one that may go; within 0 and 1, in doubles."""
    wanted = query_identifiers(query)
    shared = F.size(F.array_intersect(identifiers(line), F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
    score = F.when(_any(line, KEEP_LINES), F.lit(structural_bonus)).otherwise(F.lit(0.0))
    score = score + F.when(shared > 0, F.lit(query_match_bonus) * (shared / F.lit(float(max(len(wanted), 1))))).otherwise(F.lit(0.0))
    score = score - F.when(_any(line, DROP_LINES), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def scored_lines(chunks: DataFrame, query: str, key: list[str]) -> DataFrame:
    """key, ``ln`` (from 0), ``line``, ``n_lines``, ``relevance`` of all lines."""
    split = chunks.select(*key, lines(F.col("content")).alias("ls"))
    exploded = split.select(*key, F.size("ls").alias("n_lines"), F.posexplode("ls").alias("ln", "line"))
    return exploded.withColumn("relevance", line_relevance(F.col("line"), query))


def kept_lines(chunks: DataFrame, query: str, key: list[str], target_ratio: float = 0.5, min_score: float = 0.1, context_lines: int = 1) -> DataFrame:
    """Adds ``keep``: relevant lines and their neighbours, of which the least
    relevant go, upper lines first, down to max(3, ratio * lines)."""
    by_line = Window.partitionBy(*key).orderBy("ln")
    out = scored_lines(chunks, query, key).withColumn("hit", (F.col("relevance") >= min_score).cast("int"))
    out = out.withColumn("near", F.max("hit").over(by_line.rowsBetween(-context_lines, context_lines)) if context_lines else F.col("hit"))
    whole = Window.partitionBy(*key)
    out = out.withColumn("n_near", F.sum("near").over(whole))
    target = F.greatest(F.lit(3), F.floor(F.col("n_lines") * F.lit(target_ratio)).cast("int"))
    lowest = F.row_number().over(Window.partitionBy(*key, "near").orderBy("relevance", "ln"))
    drop = F.greatest(F.col("n_near") - target, F.lit(0))
    keep = (F.col("n_lines") <= SHORT_CHUNK) | (F.col("near") == 1) & (lowest > drop)
    return out.withColumn("keep", keep).drop("hit", "near", "n_near")


def compress(chunks: DataFrame, query: str, key: list[str], target_ratio: float = 0.5, min_score: float = 0.1, context_lines: int = 1) -> DataFrame:
    """The key and ``compressed``: kept lines, and for each run of others one
    line that tells their number. Short chunks are untouched; null and empty
    contents give no row."""
    marked = kept_lines(chunks, query, key, target_ratio, min_score, context_lines)
    by_line = Window.partitionBy(*key).orderBy("ln")
    run = F.col("ln") - F.row_number().over(Window.partitionBy(*key, "keep").orderBy("ln"))
    runs = marked.withColumn("run", F.when(~F.col("keep"), run))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "keep", "run"))
    first = F.coalesce(F.lag("keep").over(by_line), F.lit(True))
    shown = runs.withColumn("n_run", n).withColumn("opens", ~F.col("keep") & first)
    text = F.when(F.col("keep"), F.col("line")).otherwise(F.concat(F.lit("    [..."), F.col("n_run"), F.lit(" lines omitted...]")))
    left = shown.where("keep OR opens").select(*key, "ln", text.alias("text"))
    joined = left.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "text"))), lambda s: s["text"]), "\n").alias("compressed"))
    short = chunks.where(F.size(lines(F.col("content"))) <= SHORT_CHUNK).select(*key, F.col("content").alias("original"))
    return joined.join(short, key, "left").select(*key, F.coalesce("original", "compressed").alias("compressed"))
