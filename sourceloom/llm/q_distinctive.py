"""Queries of the term scores, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.llm.distinctive import term_scores
from sourceloom.session import table


def p5_term_scores(spark, sf_dir):
    scores = term_scores(table(spark, sf_dir, "chunks"))
    return scores.select("chunk_id", "field", "term", "tf", "df", "cf", F.round("residual_idf", 6).alias("residual_idf"), F.round("score", 6).alias("score"))


QUERIES = {"p5_term_scores": p5_term_scores}

ORACLES = {
    "p5_term_scores": """
WITH r AS (SELECT DISTINCT chunk_id, tokens, symbols FROM chunks),
k AS (SELECT *, row_number() OVER () AS rid FROM r),
n AS (SELECT count(*)::DOUBLE AS n FROM k),
t AS (SELECT rid, chunk_id, 'tokens' AS field, unnest(tokens) AS term FROM k
      UNION ALL SELECT rid, chunk_id, 'symbols', unnest(symbols) FROM k),
c AS (SELECT rid, chunk_id, field, lower(trim(term)) AS term, count(*) AS tf FROM t
      WHERE term IS NOT NULL AND trim(term) <> '' GROUP BY ALL),
s AS (SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY ALL),
x AS (SELECT s.*, -log2(df / n) + log2(1 - exp(-cf / n)) AS ridf FROM s, n)
SELECT chunk_id, field, term, tf, df, cf, round(ridf, 6) AS residual_idf, round(tf * ridf, 6) AS score
FROM c JOIN x USING (field, term)
""",
}
