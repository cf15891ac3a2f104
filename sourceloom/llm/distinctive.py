"""How distinctive a term is per record.

Residual inverse document frequency: the observed inverse document frequency
of a term minus the one that a Poisson process with the term's collection
frequency would give. Terms that are spread evenly score near 0, terms that are
concentrated in few records score high. Multiplied by the term's frequency in
the record it tells how much the term marks the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import durable, under

#: A term is heavy if more than one in so many of all (record, term) pairs are
#: its own; so there are fewer than so many heavy terms.
HEAVY_ONE_IN = 5000

#: Rows of the heavy side up to which it is broadcast.
HEAVY_ROWS = 20_000

#: Records that occur more than once up to which they are broadcast.
REPEAT_ROWS = 200_000


def record_repeats(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """How often each distinct record occurs: ``record``, ``__row``, ``times``."""
    return df.select(F.col(id_col).alias("record"), _row_key(fields).alias("__row")).groupBy("record", "__row").agg(F.count(F.lit(1)).alias("times"))


def record_terms(df: DataFrame, id_col: str, fields: list[str], repeats: DataFrame) -> DataFrame:
    """Frequency ``tf`` of each term in each distinct record and field.

    Terms are lower-cased and trimmed; null and empty ones don't count. All
    rows are counted and the counts of repeated records divided by how often
    these occur, so that no contents are shuffled to find repeats.
    """
    records = df.select(F.col(id_col).alias("record"), *fields).withColumn("__row", _row_key(fields))
    per_field = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("array<string>").alias("terms")) for c in fields])
    exploded = records.select("record", "__row", F.explode(per_field).alias("f")).select("record", "__row", "f.field", F.explode("f.terms").alias("term"))
    cleaned = exploded.withColumn("term", F.lower(F.trim("term"))).where(F.col("term").isNotNull() & (F.col("term") != ""))
    counted = cleaned.groupBy("record", "__row", "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    several = repeats.where("times > 1").select(F.col("record").alias("r"), F.col("__row").alias("k"), "times")
    several = F.broadcast(several) if under(several, REPEAT_ROWS) else several
    joined = counted.join(several, F.col("record").eqNullSafe(F.col("r")) & (F.col("__row") == F.col("k")), "left")
    return joined.select("record", "__row", "field", "term", F.expr("tf DIV coalesce(times, 1)").alias("tf"))


def _row_key(fields: list[str]):
    """A hash that tells different records of one id apart."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("x"))) for c in fields])


def term_scores(df: DataFrame, id_col: str = "chunk_id", fields: tuple[str, ...] = ("tokens", "symbols")) -> DataFrame:
    """Per record, field and term: ``tf``, ``df`` (records that have it), ``cf``
    (its occurrences), ``residual_idf`` and ``score`` = tf * residual_idf.

    Each field is a collection of its own; its size is the number of distinct
    records, terms or not. Repeated rows are one record, different rows under
    one id are records of their own. Records without terms give no row; other
    columns are ignored; an empty table gives an empty result.

    Statistics are pre-aggregated before the shuffle. Heavy terms, too few to
    be large, are broadcast after a check of their number; the pairs of the
    other terms are shuffled by term, of which none has more than a small share.
    """
    fields = list(fields)
    repeats = durable(record_repeats(df, id_col, fields))
    n = repeats.count()
    terms = durable(record_terms(df, id_col, fields, repeats))
    stats = terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    observed = -F.log2(F.col("df") / F.lit(float(max(n, 1))))
    expected = -F.log2(-F.expm1(-F.col("cf") / F.lit(float(max(n, 1)))))
    stats = durable(stats.withColumn("residual_idf", observed - expected))
    heavy_from = max(terms.count() // HEAVY_ONE_IN, 1)
    heavy, light = stats.where(F.col("df") > heavy_from), stats.where(F.col("df") <= heavy_from)
    if under(heavy, HEAVY_ROWS):
        names = F.broadcast(heavy)
        on_heavy = terms.join(names, ["field", "term"])
        rest = terms.join(F.broadcast(heavy.select("field", "term")), ["field", "term"], "left_anti")
    else:
        on_heavy = terms.join(heavy, ["field", "term"])
        rest = terms.join(heavy.select("field", "term"), ["field", "term"], "left_anti")
    scored = on_heavy.unionByName(rest.join(light, ["field", "term"]))
    return scored.select(F.col("record").alias(id_col), "field", "term", "tf", "df", "cf", "residual_idf", (F.col("tf") * F.col("residual_idf")).alias("score"))
