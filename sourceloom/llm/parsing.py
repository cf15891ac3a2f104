"""Source files that do not parse.

A file is lexed as a chain of ranges (see ranges), its bracket summaries are
joined in order, and its balanced top-level statements are checked by local
grammars (see syntax). A range checks the statements that lie within it; the
text before its first and after its last statement boundary is joined with that
of its neighbours and checked as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.lexing import CLOSERS, COMMENT, ENTRY_STATES, LANGUAGE_OF, OP, OPENERS, bracket_summary, extension, join_brackets, lex, line_starts
from sourceloom.llm.ranges import RANGE_CHARS, cut_ranges, entry_states, state_of
from sourceloom.llm.syntax import Bad, check_order, check_python, check_tokens
from sourceloom.session import spread

#: Spellings of languages and what they mean.
LANGUAGE_SPELLINGS = {
    "py": "python", "python3": "python", "python": "python", "js": "javascript", "jsx": "javascript", "node": "javascript", "javascript": "javascript", "ecmascript": "javascript",
    "ts": "typescript", "tsx": "typescript", "typescript": "typescript", "go": "go", "golang": "go", "rs": "rust", "rust": "rust", "java": "java",
}

_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b")


def language_of(path: str | None) -> str | None:
    """The checked language that a path's extension stands for, or None."""
    return {k: v for k, v in LANGUAGE_OF.items() if k in ("py", "js", "ts", "go", "rs", "java")}.get(extension(path))


def check_piece(language: str, text: str, first: bool = True) -> str:
    """Raises Bad unless a piece, in plain code at depth zero, is whole
    statements. Pieces behind the first skip what only a file's head needs.
    Gives marks of what may not come in any order (see check_order)."""
    if language == "python":
        check_python(text)
        return ""
    lexed = lex(language, text, None, first)
    if lexed.state:
        raise Bad("the end is inside a comment, string or template")
    if lexed.errors:
        raise Bad(lexed.errors[0][1])
    tokens = lexed.tokens
    if language == "go" and not first:
        text = "package p;" + text
        tokens = lex(language, text).tokens
    return check_tokens(language, tokens, text)


def verdict(language: str, text: str) -> str | None:
    """What is wrong with a whole file, or None."""
    try:
        check_piece(language, text)
        return None
    except Bad as e:
        return str(e)[:200]


def _boundaries(language: str, text: str, state, depth: int) -> list[int]:
    """Offsets of lines of a range that begin at depth zero in plain code,
    where a statement has ended before."""
    lexed = lex(language, text, state, False)
    out, last = [], None
    starts = iter(line_starts(text))
    line = next(starts)
    decorated = False
    for kind, word, at in lexed.tokens:
        while line is not None and line <= at:
            here, line = line, next(starts, None)
            if line is not None and line <= at:
                continue
            if depth == 0 and kind != COMMENT:
                if language == "python":
                    if here == at and last is not None and not (state and not at) and not decorated and not _CONTINUES.match(text, at) and text[max(0, here - 2) : here - 1] != "\\":
                        out.append(here)
                    decorated = word == "@" if here == at else decorated
                elif last is not None and last[0] == OP and last[1] in (";", "}"):
                    out.append(here)
        if kind == OP:
            depth += (word in OPENERS) - (word in CLOSERS)
        if kind != COMMENT:
            last = (kind, word)
    return out


def parse_check(df: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "content", range_chars: int = RANGE_CHARS) -> DataFrame:
    """One row per file in a checked language: its id, ``checked_as``,
    ``parses`` and ``reason`` (null where it parses). Contents aren't shuffled,
    save those of several ranges.

    The language is that of the path's extension; other files and null contents
    give no row. An empty file, or one with comments only, parses. Different
    contents under one id give a row per verdict. Repeated rows count once,
    other columns are ignored, an empty table gives an empty result.
    Files of any length are read whole.
    """
    ending = F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
    known = {k: v for k, v in LANGUAGE_OF.items() if k in ("py", "js", "ts", "go", "rs", "java")}
    named = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[ending]
    files = df.select(F.col(id_col).alias("id"), named.alias("language"), F.col(text_col).alias("content")).where("language IS NOT NULL AND content IS NOT NULL")
    kind = files.schema["id"].dataType.simpleString()
    files = files.withColumn("file", F.xxhash64("id", "language", "content"))
    ranges = cut_ranges(spread(files), "content", range_chars)
    single, several = ranges.where("n_ranges = 1"), ranges.where("n_ranges > 1").dropDuplicates(["file", "range_no"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons = [verdict(lang, text) for lang, text in zip(pdf["language"], pdf["range_text"])]
            yield pd.DataFrame({"id": pdf["id"], "checked_as": pdf["language"].tolist(), "parses": [r is None for r in reasons], "reason": reasons})

    schema = f"id {kind}, checked_as string, parses boolean, reason string"
    out = single.select("id", "language", "range_text").mapInPandas(whole, schema)
    if not several.isEmpty():
        out = out.unionByName(_of_ranges(several, kind).select("id", "checked_as", "parses", "reason"))
    return out.distinct().withColumnRenamed("id", id_col)


def _of_ranges(ranges: DataFrame, kind: str) -> DataFrame:
    """parse_check for files of several ranges."""
    key = ["file"]

    def end_state(row, state):
        lexed = lex(row["language"], row["range_text"], state, row["range_no"] == 0)
        return lexed.state, not lexed.errors

    entries = entry_states(ranges, key, lambda row: ENTRY_STATES[row["language"]], end_state)
    known = ranges.join(entries, [*key, "range_no"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                lexed = lex(r.language, r.range_text, state_of(r.entry), r.range_no == 0)
                closing, opening, bad = bracket_summary(lexed.tokens)
                rows.append([r.file, r.range_no, closing, opening, bad, lexed.errors[0][1] if lexed.errors else None, lexed.state is not None])
            yield pd.DataFrame(rows, columns=["file", "range_no", "closing", "opening", "misfit", "error", "open"])

    summaries = known.mapInPandas(summarise, "file bigint, range_no int, closing string, opening string, misfit boolean, error string, open boolean")

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        total, rows, error = ("", "", False), [], None
        pdf = pdf.sort_values("range_no")
        for r in pdf.itertuples():
            rows.append([r.file, r.range_no, len(total[1].split())])
            total = join_brackets(total, (r.closing, r.opening, r.misfit))
            error = error or r.error
        if error is None and (total[0] or total[1] or total[2]):
            error = "brackets don't fit"
        if error is None and bool(pdf["open"].iloc[-1]):
            error = "the end is inside a comment, string or template"
        return pd.DataFrame([[*x, error] for x in rows], columns=["file", "range_no", "depth", "error"])

    depths = summaries.groupBy("file").applyInPandas(prefix, "file bigint, range_no int, depth int, error string")

    def statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                error = r.error if isinstance(r.error, str) else None
                if error:
                    rows.append([r.file, r.id, r.language, r.range_no, "", "", True, False, "", error])
                    continue
                at = _boundaries(r.language, r.range_text, state_of(r.entry), r.depth)
                if r.range_no == 0:
                    at = [0, *[x for x in at if x]]
                if not at:
                    rows.append([r.file, r.id, r.language, r.range_no, r.range_text, "", False, False, "", None])
                    continue
                marks = ""
                try:
                    if at[0] < at[-1]:
                        marks = check_piece(r.language, r.range_text[at[0] : at[-1]], r.range_no == 0)
                except Bad as e:
                    error = str(e)
                rows.append([r.file, r.id, r.language, r.range_no, r.range_text[: at[0]], r.range_text[at[-1] :], True, at[-1] == 0, marks, error])
            yield pd.DataFrame(rows, columns=["file", "id", "language", "range_no", "head", "tail", "cut", "whole", "marks", "error"])

    parts = known.join(depths, ["file", "range_no"]).mapInPandas(
        statements, f"file bigint, id {kind}, language string, range_no int, head string, tail string, cut boolean, whole boolean, marks string, error string"
    )

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_no")
        language = pdf["language"].iloc[0]
        error = next((e for e in pdf["error"] if isinstance(e, str)), None)
        if error is None:
            pieces, pending, first, before = [], "", False, ""
            for r in pdf.itertuples():
                pending += r.head
                if r.cut:
                    pieces += [(pending, first, None), ("", False, r.marks)]
                    pending, first = r.tail, r.range_no == 0 and r.whole
            try:
                for piece, first, marks in [*pieces, (pending, first, None)]:
                    marks = check_piece(language, piece, first) if marks is None else marks
                    check_order(before, marks)
                    before += marks
            except Bad as e:
                error = str(e)
        return pd.DataFrame([[pdf["id"].iloc[0], language, error is None, error]], columns=["id", "checked_as", "parses", "reason"])

    return parts.groupBy("file").applyInPandas(stitch, f"id {kind}, checked_as string, parses boolean, reason string")


def clean_language(language, path):
    """A language column in one spelling; by the path's extension where null."""
    spelled = F.create_map(*[F.lit(x) for kv in LANGUAGE_SPELLINGS.items() for x in kv])
    given = F.lower(F.trim(language))
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(spelled[given], F.when(given != "", given), spelled[ending])


def parse_rates(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Per project and cleaned language: ``n_files``, ``n_broken`` and ``rate``.

    The language of a file is that of its scans in files, the most frequent one
    if they differ (ties: the first by name), else that of its extension.
    """
    cleaned = files.distinct().select("file_id", clean_language(F.col("language"), F.col("path")).alias("language"))
    counted = cleaned.where("language IS NOT NULL").groupBy("file_id", "language").count()
    named = counted.groupBy("file_id").agg(F.min_by("language", F.struct(-F.col("count"), "language")).alias("language"))
    checked = parse_check(sources).join(sources.select("file_id", "project").distinct(), "file_id").join(named, "file_id", "left")
    return (
        checked.groupBy("project", F.coalesce("language", "checked_as").alias("language"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.when(F.col("parses"), 0).otherwise(1)).alias("n_broken"))
        .withColumn("rate", F.col("n_broken") / F.col("n_files"))
    )


def broken_symbols(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """What symbols still hold of each file that doesn't parse: ``n_symbols``,
    ``n_top_level``, ``last_line`` (null where nothing is left)."""
    broken = parse_check(sources).where(~F.col("parses")).select("file_id", "reason")
    kept = symbols.distinct().groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count(F.when(F.col("parent_ord").isNull(), 1)).alias("n_top_level"), F.max("line").alias("last_line")
    )
    return broken.join(kept, "file_id", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))).withColumn("n_top_level", F.coalesce("n_top_level", F.lit(0)))
