"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the line ends at which Python's splitlines cuts.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"

#: Whole words, and the parts of a word that become tokens.
WORD = r"[a-zA-Z_][a-zA-Z0-9_]*"
PART = r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+"


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the end opens no further line, and an
    empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_count(text: Column) -> Column:
    """LFs plus one, the line count of a scan."""
    return (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("int")


def tokens(text: Column) -> Column:
    """Identifiers split at case changes, underscores and digits, lower-cased.
    A word of which no part remains stays whole."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    parts = F.transform(
        words,
        lambda w: F.when(F.size(F.regexp_extract_all(w, F.lit(PART), F.lit(0))) > 0, F.regexp_extract_all(w, F.lit(PART), F.lit(0))).otherwise(F.array(w)),
    )
    return F.transform(F.flatten(parts), lambda p: F.lower(p))


def identifiers(text: Column) -> Column:
    """The set of whole identifiers, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def query_tokens(query: str) -> list[str]:
    """tokens() of a query, as a bag in order."""
    out: list[str] = []
    for word in re.findall(WORD, query):
        out += [p.lower() for p in re.findall(PART, word) or [word]]
    return out


def query_identifiers(query: str) -> list[str]:
    """identifiers() of a query, sorted."""
    return sorted(set(re.findall(WORD, query.lower())))


def source_type(path: Column) -> Column:
    """test, doc, config or code, by the first rule that holds for a path."""
    p = F.lower(path)

    def ends(*suffixes: str) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | p.endswith(s)
        return out

    return (
        F.when(F.contains(p, F.lit("test")), "test")
        .when(ends(".md", ".rst", ".txt"), "doc")
        .when(ends(".toml", ".yaml", ".yml", ".json", ".cfg", ".ini"), "config")
        .otherwise("code")
    )


def glob_regex(pattern: str) -> str:
    """A file name pattern as a regular expression on whole paths; a star
    crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_pattern(path: Column, pattern: str) -> Column:
    """Without a star: the same path or a prefix of it; else the glob."""
    return path.rlike(glob_regex(pattern)) if "*" in pattern else path.startswith(pattern)


def path_filter(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """(no include or any of them) and none of exclude; empty lists filter
    nothing."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for p in include:
            keep = keep | matches_pattern(path, p)
    for p in exclude or []:
        keep = keep & ~matches_pattern(path, p)
    return keep


def is_template(text: Column) -> Column:
    """Whether every line is blank, a heading or a comment of one line."""
    stripped = F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.forall(stripped, lambda s: (s == "") | s.startswith("#") | (s.startswith("<!--") & s.endswith("-->")))


def is_unfilled(text: Column) -> Column:
    """Whether the last line opens a comment."""
    return F.contains(F.element_at(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), -1), F.lit("<!-- "))


def walk_key(path: Column) -> Column:
    """Orders paths as a walk does: by name, files of a directory before its
    subdirectories."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.transform(parts, lambda name, i: F.struct((i < last).cast("int").alias("is_dir"), name.alias("name")))


def rough_tokens(text: Column) -> Column:
    """A token count without a vocabulary: words, numbers and signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"), F.lit(0)))
