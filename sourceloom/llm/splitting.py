"""Splitting oversized items at natural boundaries.

Long contents are cut into ranges at line ends; workers find the unit
boundaries of each range, one line run above a range's first line being settled
when the boundary tables of an item are stitched. Line lengths are summed up to
offsets, and pieces are planned on the boundary table alone and then cut out by
offset, each range giving its share. For an item of one range, that is one of
at most RANGE_CHARS characters, one worker makes and stitches its table of one
row. An item that begins in the midst of a file has an unknown state at its
start, which its whole text settles, in one range or in several.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.lexing import ENTRY_STATES, LANGUAGE_OF, bracket_summary, extension, join_brackets, lex
from sourceloom.llm.ranges import RANGE_CHARS, cut_ranges, entry_states, state_of
from sourceloom.llm.units import MD_ENTRY, code_units, markdown_units, window_entry
from sourceloom.session import spread

#: An item is oversized above either limit; pieces stay within both.
MAX_LINES, MAX_CHARS = 60, 4000

#: Lines that a piece repeats from the end of the one before, and characters
#: where a single line is cut.
OVERLAP_LINES, OVERLAP_CHARS = 5, 200

#: Columns of a boundary table that stitching reads.
_ROW = ["lengths", "units", "blanks", "reach", "run", "whole"]


def unit_kind(uri: str | None) -> str | None:
    """A language, "markdown", or None where no units are defined."""
    end = extension(uri)
    return "markdown" if end in ("md", "markdown") else LANGUAGE_OF.get(end)


def unit_lines(uri: str | None, text: str, window: bool = False) -> list[int]:
    """Lines (from 0) of a whole content at which a unit begins."""
    kind = unit_kind(uri)
    return _stitch([_whole_row(kind, text, window)])[1]


def plan_pieces(lengths: list[int], units: list[int], blanks: set[int], max_lines: int, max_chars: int, overlap: int, overlap_chars: int):
    """Cuts lines of the given lengths (with line ends) into pieces.

    Gives (first line, last line, start offset, end offset). A piece ends
    before a unit where one begins in its last three quarters, else before a
    blank line there, else where the limits end it. The next piece begins
    ``overlap`` lines earlier, fewer if the limits or progress ask for it. A
    line longer than the limit is cut by characters with its own overlap.
    """
    offset = [0, *accumulate(lengths)]
    n, out, start = len(lengths), [], 0
    marks = set(units)
    fresh = 0
    while fresh < n:
        if lengths[fresh] > max_chars:
            a, end = offset[fresh], offset[fresh + 1]
            while True:
                b = min(a + max_chars, end)
                out.append((fresh, fresh, a, b))
                if b == end:
                    break
                a = max(b - overlap_chars, a + 1)
            fresh += 1
            start = fresh
            continue
        while start < fresh and offset[fresh + 1] - offset[start] > max_chars:
            start += 1
        stop = fresh
        while stop < n and stop - start < max_lines and offset[stop + 1] - offset[start] <= max_chars:
            stop += 1
        if stop < n:
            floor = max(fresh + 1, start + (stop - start) // 4)
            cut = next((k for k in range(stop, floor - 1, -1) if k in marks), None)
            if cut is None:
                cut = next((k for k in range(stop, floor - 1, -1) if k in blanks), stop)
            stop = cut
        out.append((start, stop - 1, offset[start], offset[stop]))
        fresh = stop
        start = max(fresh - overlap, 0) if fresh not in marks or overlap else fresh
        while start < fresh and lengths[start] > max_chars:
            start += 1
    return out


def oversized(df: DataFrame, text_col: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows whose text has more lines (split at LF) or characters than allowed."""
    text = F.col(text_col)
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    return df.where((lines > max_lines) | (F.char_length(text) > max_chars))


def _items(df: DataFrame, id_col: str, uri_col: str, text_col: str, start_col: str, max_lines: int, max_chars: int) -> DataFrame:
    """Oversized items with a key of their own; repeats are dropped later, so
    that contents needn't be shuffled."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(start_col).cast("int").alias("start_line"), F.col(text_col).alias("content"))
    return oversized(chosen, "content", max_lines, max_chars).withColumn("item", F.xxhash64("id", "uri", "start_line", "content"))


def _in_midst(start_line) -> bool:
    """Whether an item begins behind the first line of its file."""
    return bool(pd.notna(start_line) and start_line > 1)


def _range_row(kind: str | None, text: str, state, depth: int, first: bool, window: bool) -> tuple:
    """The boundary table of one range: lengths of its lines, units and blanks
    among them, and what it says of the lines above units (see code_units)."""
    units, reach, run, whole = [], False, 0, False
    if kind == "markdown":
        units = markdown_units(text, state)[0]
    elif kind:
        found, run, whole = code_units(kind, text, state, depth, first and not window, window)
        units, reach = [u for u, _ in found], any(x for _, x in found)
    lines = _lines(text)
    return [len(x) for x in lines], units, [k for k, x in enumerate(lines) if not x.strip()], reach, run, whole


def _whole_row(kind: str | None, text: str, window: bool) -> tuple:
    """The boundary table of an item of one range."""
    state, depth = (MD_ENTRY[0], 0) if kind == "markdown" else window_entry(kind, text) if kind and window else (None, 0)
    return _range_row(kind, text, state, depth, True, window)


def _unit_table(ranges: DataFrame) -> DataFrame:
    """For items of several ranges: item, range_no, ``lengths`` of its lines
    and the ``units`` and ``blanks`` among them, lines counted in the range."""

    def candidates(row):
        kind = unit_kind(row["uri"])
        return MD_ENTRY if kind == "markdown" else (ENTRY_STATES[kind] if kind else [None])

    def end_state(row, state):
        kind = unit_kind(row["uri"])
        if kind == "markdown":
            return markdown_units(row["range_text"], state)[1], True
        lexed = lex(kind, row["range_text"], state, row["range_no"] == 0 and not _in_midst(row["start_line"])) if kind else None
        return (lexed.state, not lexed.errors) if lexed else (None, True)

    def unsure(row):
        return unit_kind(row["uri"]) not in (None, "markdown") and _in_midst(row["start_line"])

    known = ranges.join(entry_states(ranges, ["item"], candidates, end_state, unsure), ["item", "range_no"])

    def brackets(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                kind = unit_kind(r.uri)
                s = ("", "", False)
                if kind and kind != "markdown":
                    s = bracket_summary(lex(kind, r.range_text, state_of(r.entry), r.range_no == 0 and not _in_midst(r.start_line)).tokens)
                rows.append([r.item, r.range_no, _in_midst(r.start_line), *s])
            yield pd.DataFrame(rows, columns=["item", "range_no", "window", "closing", "opening", "misfit"])

    def prefix(pdf):
        pdf = pdf.sort_values("range_no")
        total = ("", "", False)
        for r in pdf.itertuples():
            total = join_brackets(total, (r.closing, r.opening, r.misfit))
        at = len(total[0].split()) if bool(pdf["window"].iloc[0]) and not total[2] else 0
        rows, total = [], ("", " ".join(["{"] * at), False)
        for r in pdf.itertuples():
            rows.append([r.item, r.range_no, len(total[1].split())])
            total = join_brackets(total, (r.closing, r.opening, r.misfit)) if not total[2] else total
        return pd.DataFrame(rows, columns=["item", "range_no", "depth"])

    depths = known.mapInPandas(brackets, "item bigint, range_no int, window boolean, closing string, opening string, misfit boolean").groupBy("item").applyInPandas(prefix, "item bigint, range_no int, depth int")

    def find(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                row = _range_row(unit_kind(r.uri), r.range_text, state_of(r.entry), r.depth, r.range_no == 0, _in_midst(r.start_line))
                rows.append([r.item, r.id, r.start_line, r.range_no, *row])
            yield pd.DataFrame(rows, columns=["item", "id", "start_line", "range_no", *_ROW])

    kind = ranges.schema["id"].dataType.simpleString()
    return known.join(depths, ["item", "range_no"]).mapInPandas(
        find, f"item bigint, id {kind}, start_line int, range_no int, lengths array<int>, units array<int>, blanks array<int>, reach boolean, run int, whole boolean"
    )


def _lines(text: str) -> list[str]:
    """Lines with their ends; a last line without text isn't one here."""
    out = text.split("\n")
    lines = [x + "\n" for x in out[:-1]]
    return lines + [out[-1]] if out[-1] else lines


def _in_order(pdf: pd.DataFrame) -> list[tuple]:
    return list(pdf.sort_values("range_no")[_ROW].itertuples(index=False, name=None))


def _stitch(rows: list[tuple]) -> tuple[list[int], list[int], set[int]]:
    """Line lengths, units and blank lines of a whole item from its ranges."""
    lengths, units, blanks, run = [], set(), set(), 0
    for row_lengths, row_units, row_blanks, reach, row_run, whole in rows:
        base = len(lengths)
        for u in row_units:
            units.add(base + u - (run if reach and u == 0 else 0))
        run = row_run + (run if whole else 0)
        blanks.update(base + b for b in row_blanks)
        lengths.extend(row_lengths)
    return [int(x) for x in lengths], sorted(int(u) for u in units), blanks


def unit_boundaries(
    df: DataFrame, id_col: str = "chunk_id", uri_col: str = "uri", text_col: str = "content", start_col: str = "start_line",
    max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """Per oversized item a row for each line (``line_no``, from 1, the first
    line left out) at which a unit begins; one row with 0 if there is none.

    Null contents and such within the limits give no row. Repeated rows count
    once; different contents under one id give the union of their lines. A null
    uri or one of an unknown extension has no units. A start line above 1 says
    that the content begins in the midst of a file. Other columns are ignored,
    an empty table gives an empty result.
    """
    ranges = cut_ranges(spread(_items(df, id_col, uri_col, text_col, start_col, max_lines, max_chars)), "content", range_chars)
    kind = ranges.schema["id"].dataType.simpleString()
    schema = f"id {kind}, line_no int"

    def rows_of(item_id, units: list[int]) -> list:
        lines = sorted({u + 1 for u in units if u > 0})
        return [[item_id, x] for x in lines or [0]]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for r in pdf.itertuples() for x in rows_of(r.id, unit_lines(r.uri, r.range_text, _in_midst(r.start_line)))]
            yield pd.DataFrame(rows, columns=["id", "line_no"])

    out = ranges.where("n_ranges = 1").mapInPandas(whole, schema)
    several = ranges.where("n_ranges > 1").dropDuplicates(["item", "range_no"])
    if not several.isEmpty():

        def joined(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(rows_of(pdf["id"].iloc[0], _stitch(_in_order(pdf))[1]), columns=["id", "line_no"])

        out = out.unionByName(_unit_table(several).groupBy("item").applyInPandas(joined, schema))
    return out.distinct().withColumnRenamed("id", id_col)


def split_items(
    df: DataFrame, id_col: str = "chunk_id", uri_col: str = "uri", text_col: str = "content", start_col: str = "start_line",
    max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS, range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """The pieces of each oversized item: id, ``piece_no`` (from 1),
    ``start_line`` and ``end_line`` in the file (counted from the item's own
    start line, or 1 where that is null), ``start_offset`` in the content and
    ``piece``, its text. Pieces are within both limits and cover the whole
    content; where null, within limits or repeated: as in unit_boundaries.
    """
    ranges = cut_ranges(spread(_items(df, id_col, uri_col, text_col, start_col, max_lines, max_chars)), "content", range_chars)
    kind = ranges.schema["id"].dataType.simpleString()
    columns = ["id", "piece_no", "start_line", "end_line", "start_offset", "piece"]
    schema = f"id {kind}, piece_no int, start_line int, end_line int, start_offset int, piece string"

    def first_line(start) -> int:
        return int(start) if pd.notna(start) else 1

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                lengths, units, blanks = _stitch([_whole_row(unit_kind(r.uri), r.range_text, _in_midst(r.start_line))])
                plan = plan_pieces(lengths, units, blanks, max_lines, max_chars, overlap_lines, overlap_chars)
                base = first_line(r.start_line)
                rows += [[r.id, k + 1, base + a, base + b, x, r.range_text[x:y]] for k, (a, b, x, y) in enumerate(plan)]
            yield pd.DataFrame(rows, columns=columns)

    out = ranges.where("n_ranges = 1").mapInPandas(whole, schema)
    several = ranges.where("n_ranges > 1").dropDuplicates(["item", "range_no"])
    if not several.isEmpty():

        def planned(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths, units, blanks = _stitch(_in_order(pdf))
            base = first_line(pdf["start_line"].iloc[0])
            plan = plan_pieces(lengths, units, blanks, max_lines, max_chars, overlap_lines, overlap_chars)
            return pd.DataFrame([[pdf["item"].iloc[0], k + 1, base + a, base + b, x, y] for k, (a, b, x, y) in enumerate(plan)], columns=["item", "piece_no", "start_line", "end_line", "a", "b"])

        plans = _unit_table(several).groupBy("item").applyInPandas(planned, "item bigint, piece_no int, start_line int, end_line int, a int, b int")
        texts = several.select("item", "id", "range_no", "range_start", "range_text", F.char_length("range_text").alias("n"))
        shares = plans.join(texts, "item").where((F.col("a") < F.col("range_start") + F.col("n")) & (F.col("b") > F.col("range_start")))
        shares = shares.withColumn("from", F.greatest(F.col("a") - F.col("range_start"), F.lit(0))).withColumn("to", F.least(F.col("b") - F.col("range_start"), F.col("n")))
        shares = shares.withColumn("share", F.expr("substring(range_text, `from` + 1, `to` - `from`)"))
        cut = shares.groupBy("item", "piece_no").agg(
            F.first("id").alias("id"), F.first("start_line").alias("start_line"), F.first("end_line").alias("end_line"), F.first("a").alias("start_offset"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "share"))), lambda s: s["share"]), "").alias("piece"),
        )
        out = out.unionByName(cut.select(*columns))
    return out.distinct().withColumnRenamed("id", id_col)
