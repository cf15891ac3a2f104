"""Texts cut into ranges, and states handed from range to range.

A text longer than RANGE_CHARS is cut at the line ends next after every
RANGE_CHARS characters, so that several workers can take parts of one giant
text. What a range means depends on the state in which it begins (inside a
comment, say). Each range is scanned from all likely states at once; the small
results are joined in order per text, which tells the state in which each
range really begins. A state that nobody tried is scanned in another pass over
just that range. Where even the state of a text's start is unknown, as for a
part of a file, the whole chain tells which one fits. Texts of one range need
no chain.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import durable

#: Characters after which a text is cut at the next line end.
RANGE_CHARS = 1_000_000


def cut_ranges(df: DataFrame, text_col: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Adds ``range_no``, ``n_ranges``, ``range_start`` (characters before it)
    and ``range_text``, one row per range, instead of the text. An empty text
    is one empty range; a null text has no row."""
    text = f"`{text_col}`"
    cuts = F.expr(
        f"""CASE WHEN char_length({text}) <= {range_chars} THEN array(0, char_length({text}))
        ELSE array_sort(array_distinct(concat(array(0), filter(transform(sequence(1, CAST(floor(char_length({text}) / {range_chars}) AS INT)),
          k -> locate(chr(10), {text}, k * {range_chars})), c -> c > 0), array(char_length({text}))))) END"""
    )
    out = df.where(F.col(text_col).isNotNull()).withColumn("__cuts", cuts)
    spans = F.expr(
        "CASE WHEN size(__cuts) < 3 THEN array(struct(0 AS k, 0 AS a, element_at(__cuts, -1) AS b)) "
        "ELSE transform(sequence(0, size(__cuts) - 2), k -> struct(k AS k, __cuts[k] AS a, __cuts[k + 1] AS b)) END"
    )
    out = out.withColumn("__spans", spans).withColumn("n_ranges", F.size("__spans")).withColumn("__span", F.explode("__spans"))
    return out.select(
        *[c for c in df.columns if c != text_col],
        F.col("__span.k").alias("range_no"),
        "n_ranges",
        F.col("__span.a").alias("range_start"),
        F.when(F.col("n_ranges") == 1, F.col(text_col))
        .otherwise(F.expr(f"substring({text}, __span.a + 1, __span.b - __span.a)"))
        .alias("range_text"),
    )


def state_key(state) -> str:
    """A state as text."""
    return json.dumps(state)


def state_of(key: str):
    """The state of a text; tuples come back as tuples."""

    def tuples(x):
        return tuple(tuples(y) for y in x) if isinstance(x, list) else x

    return tuples(json.loads(key))


def entry_states(ranges: DataFrame, key: list[str], candidates: Callable, scan: Callable, unsure: Callable = lambda row: False) -> DataFrame:
    """For ranges of texts of several ranges: the state in which each begins.

    candidates(row) lists the states to try, the first being that of a text's
    start; scan(row, state) gives the state at the range's end and whether the
    range has no error. unsure(row) tells that the state of the text's start is
    unknown: it is then the first candidate from which the text has no error
    and ends in no state, else the first of all. Gives key, range_no and
    ``entry`` (a state as text). Only states travel, no text.
    """
    kinds = ", ".join(f"`{c}` {ranges.schema[c].dataType.simpleString()}" for c in key)

    def tried(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                states = [state_of(row["wanted"])] if row.get("wanted") else candidates(row)
                if row["range_no"] == 0 and not row.get("wanted") and not unsure(row):
                    states = states[:1]
                for rank, s in enumerate(states):
                    end, fits = scan(row, s)
                    rows.append([row[c] for c in key] + [row["range_no"], rank, state_key(s), state_key(end), fits])
            yield pd.DataFrame(rows, columns=[*key, "range_no", "rank", "entry", "exit", "fits"])

    schema = f"{kinds}, range_no int, rank int, entry string, exit string, fits boolean"
    known = durable(ranges.mapInPandas(tried, schema))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        moves = {(r.range_no, r.entry): (r.exit, r.fits) for r in pdf.itertuples()}
        starts = pdf[pdf.range_no == 0].sort_values("rank").entry
        last = int(pdf.range_no.max())
        plain = None
        for first in starts:
            out, state, good = [], first, True
            for k in range(last + 1):
                here = (k, state) in moves
                out.append([pdf[c].iloc[0] for c in key] + [k, state, here])
                if not here:
                    break
                state, fits = moves[(k, state)]
                good = good and fits
            if not out[-1][-1] or good and not state_of(state):
                break
            plain = plain or out
            out = plain
        return pd.DataFrame(out, columns=[*key, "range_no", "entry", "known"])

    while True:
        chained = durable(known.groupBy(*key).applyInPandas(chain, f"{kinds}, range_no int, entry string, known boolean"))
        missing = chained.where(~F.col("known")).select(*key, "range_no", F.col("entry").alias("wanted"))
        if missing.isEmpty():
            return chained.select(*key, "range_no", "entry")
        known = durable(known.unionByName(ranges.join(missing, [*key, "range_no"]).mapInPandas(tried, schema)))
