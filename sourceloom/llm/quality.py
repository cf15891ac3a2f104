"""Per-document text quality statistics.

An exact count of the characters that stand inside sentences tells of each
document by itself whether it can be prose, whatever the others of its language
are. Each statistic of those that can is summed up per language in a mergeable
quantile sketch (KLL), so that tables and code, even if they are many, don't
move the reference. Distances from there become robust z-scores, and documents
in the tails are flagged. Where the words of a document are far out, both by
how few are common and by how few of their letters are vowels, it isn't prose
either: junk letters meet short common words by chance and so pass as sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.session import durable, spread, under

#: Words that the table of common words may have; it is a fixed list, which
#: doesn't grow with the documents, and is sent to all workers.
MOST_COMMON_WORDS = 50_000

#: Robust z-score from which a value is in a tail.
TAIL = 2.0

#: Robust z-score from which the words of a text aren't those of prose.
FAR = 3.0

#: Statistics that tell so if all of them are far out; one alone may be in
#: prose, as in a short sentence with few common words.
OF_WORDS = ("common_share", "vowel_share")

#: Size of the sketches; below that many documents of a language they are exact.
SKETCH_SIZE = 4_096

#: Share of visible characters inside sentences below which a text isn't prose.
PROSE_SHARE = 0.5

#: Statistics: whether prose is at the upper or the lower end, and the least
#: spread that counts (values are shares or lengths in characters).
TAILS = {
    "sentence_share": ("high", 0.08), "common_share": ("high", 0.04), "symbol_share": ("low", 0.02),
    "digit_share": ("low", 0.02), "punct_line_share": ("high", 0.2), "mean_word_chars": ("low", 0.5),
    "vowel_share": ("high", 0.025),
}

#: Spellings of language tags.
LANGUAGE_TAGS = {"english": "en", "german": "de", "deutsch": "de", "french": "fr", "spanish": "es", "chinese": "zh"}

_DIGIT, _NO_ALNUM = re.compile(r"\d"), re.compile(r"[\W_]+")
_WORD = re.compile(r"(?<!\w)[^\W\d_]++(?:['’][^\W\d_]++)*(?!\w)")
_ASCII_WORD = re.compile(r"\b[A-Za-z]++(?:'[A-Za-z]++)*\b(?!_)", re.ASCII)
_BLANKS, _ASCII_DIGITS = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", b"0123456789"
_ASCII_ALNUM = _ASCII_DIGITS + bytes(range(65, 91)) + bytes(range(97, 123))
_ASCII_VOWELS, _VOWEL = b"aeiouyAEIOUY", re.compile(r"[aeiouyàáâãäåæąèéêëęìíîïıòóôõöøőœùúûüůűýÿ]")
_RARE_END = re.compile(r"[\r\x0b\x0c]")
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_CODE_START = re.compile(
    r"^\s*(?://|/\*|\*/|\*\s|\#\s*(?:include|define|!/)|@\w|(?:import|from|package|use|def|class|func|fn|pub|const|let|var|return|public|private|static|final|export|async|impl|struct|enum|interface|type|if|elif|for|while|try|catch|except|switch|case|raise|throw|with|assert|SELECT|INSERT|UPDATE)\b[^.]*[(){}=:;]\s*$|[\w.-]+\s*[:=]\s*\S*$|at\s+[\w.$]+\()"
    r"|^\s*(?:[\w.]+(?:,\s*[\w.]+)*\s*(?:[-+*/|&%:]?=|<-)\s+\S|assert\s+(?:not\s+)?[\w.]+\s+(?:is|in|not)\b.*,\s*[rbfu]?[\"']|(?:raise|throw\s+new)\s+[\w.]+\(|[\w.]+\(.*\)[;,]?\s*$)"
)
_CODE_END = re.compile(r"\)\s*:\s*$")
_CJK_STOP, _PACKED = re.compile(r"[，。！？、；]"), re.compile(r"[,;](?=\S)")
_QUOTED, _MAYBE_CODE, _MAYBE_NAMED = re.compile(r"`[^`]*`|https?://\S+"), re.compile(r"[=>(\[<]|&&|\|\||::"), re.compile(r"[`_-]")
_CODE_INSIDE = re.compile(r"(?:==|!=|=>|->|::|\+=|-=|&&|\|\||\w\(\w*\)|\w\.\w+\(|\w\[\w+\]|</?\w+>|\w=[\w\"'])")
_RULE = re.compile(r"^[\s|+=_*~#.:│├└─┌┐┘┬┴┼-]*$")
_CELLS = re.compile(r"^\s*[|│├└+]|\s\|\s.*\s\|\s|\S {3,}\S.*\S {3,}\S|\S\t+\S.*\S\t+\S")
_NAMED = re.compile(r"`[^`\n]*`|(?<!\w)\w+(?:_\w+)+|(?<![\w-])[a-z]+-[a-z]+(?:-[a-z]+)*(?![\w-])")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+(?:\.\d+)*[.)]?|\[[ xX]?\]|[a-zA-Z][.)])\s+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d|[0-9a-f]{8}\s\s)")
_END = re.compile(r"[.!?…。！？:;：；][\"'”’)\]»]*\s*$")


class Words:
    """The common words by language."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.by: dict[str, set[str]] = {}
        for lang, word in rows:
            if lang and word:
                self.by.setdefault(lang.strip().lower()[:2], set()).add(word.strip().lower())
        cjk = sorted((w for words in self.by.values() for w in words if _CJK.search(w)), key=len, reverse=True)
        self.cjk = re.compile("|".join(map(re.escape, cjk))) if cjk else None
        self.cjk_languages = {lang for lang, words in self.by.items() if any(_CJK.search(w) for w in words)}

    def hits(self, words: list[str], language: str | None) -> int:
        return sum(map(self.by.get(language or "", frozenset()).__contains__, words))

    def cjk_chars(self, text: str) -> int:
        return sum(len(m.group()) for m in self.cjk.finditer(text)) if self.cjk else 0

    def language(self, counts: Counter, letters: int, cjk: int) -> str | None:
        """The language with the most hits, ties by name; None without hits."""
        if cjk and cjk * 4 > letters and self.cjk_languages:
            return min(self.cjk_languages)
        hits = ((sum(counts[w] for w in self.by[lang] if w in counts), lang) for lang in sorted(self.by, reverse=True) if lang not in self.cjk_languages)
        best = max(hits, default=(0, None))
        return best[1] if best[0] else None


def _visible(text: str) -> int:
    return len(text.encode().translate(None, _BLANKS)) if text.isascii() else len("".join(text.split()))


def _lines(text: str) -> list[str]:
    return _LINE_END.split(text) if not text.isascii() or _RARE_END.search(text) else text.split("\n")


def _words(low: str) -> list[str]:
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def is_sentence(line: str, found: list[str], words: Words, language: str | None) -> bool | None:
    """Whether a line, of which found are the words, is (part of) sentences;
    None if it is too short to tell."""
    if _RULE.match(line):
        return False
    if not line.isascii():
        cjk = len(_CJK.findall(line))
        if cjk >= 4 and cjk * 3 >= _visible(_NAMED.sub(" x ", line)) * 0.8:
            return words.cjk_chars(line) / cjk >= 0.12 or bool(_CJK_STOP.search(line)) and cjk >= 6
    if "|" in line or "   " in line or "\t" in line or line.lstrip()[:1] in "│├└+":
        if _CELLS.search(line):
            return False
    ends = line.rstrip()
    if ends[-1] in "{}\\" or ends[-1] == ";" and not _is_clause(line, found, words, language) or ends.endswith("=>") or ends[-1] == ":" and _CODE_END.search(line):
        return False
    if _LOG.match(line) or _CODE_START.match(_BULLET.sub("", line)):
        return False
    if line.strip().count(" ") <= 2 and len(_PACKED.findall(line)) >= 2:
        return False
    plain = line
    if _MAYBE_NAMED.search(line):
        plain = _NAMED.sub(" x ", line)
        found = _words(plain.lower())
    n = len(found)
    inside = len(_CODE_INSIDE.findall(_QUOTED.sub("", line))) if _MAYBE_CODE.search(line) else 0
    if inside >= 2 or inside and n < 8:
        return False
    if n < 4:
        return None
    if sum(map(len, found)) < 0.72 * _visible(plain):
        return False
    share = words.hits(found, language) / n
    return share >= 0.2 or share >= 0.12 and n >= 8 or (None if share >= 0.1 else False)


def _is_clause(line: str, found: list[str], words: Words, language: str | None) -> bool:
    """Whether a line that ends in a semicolon is words of a sentence."""
    n = len(found)
    return n >= 6 and words.hits(found, language) >= 0.25 * n and not _MAYBE_CODE.search(line[:-1]) and line.count(";") == 1


def text_statistics(text: str, words: Words) -> dict:
    """The statistics of one text with at least one visible character."""
    lines = _lines(text)
    low = text.lower()
    by_line = [_words(x) for x in (_lines(low) if len(low) == len(text) else map(str.lower, lines))]
    counts: Counter = Counter(w for found in by_line for w in found)
    n_words = sum(map(len, by_line))
    letters = sum(len(w) * n for w, n in counts.items())
    cjk = 0 if text.isascii() else len(_CJK.findall(text))
    language = words.language(counts, letters, cjk)
    visible = max(_visible(text), 1)
    inside, before = 0, False
    n_full = sum(bool(x.strip()) for x in lines)
    ended = 0
    for line, found in zip(lines, by_line):
        if not line.strip():
            before = False
            continue
        ends = line.rstrip()
        ended += bool(_END.search(ends, max(0, len(ends) - 40)))
        kind = is_sentence(line, found, words, language)
        if kind is None:
            kind = before and not _BULLET.match(line)
            if not kind and len(found) >= 2 and n_full <= 2:
                kind = words.hits(found, language) >= 1 and bool(_END.search(line))
        if kind:
            inside += _visible(line)
        before = kind
    if text.isascii():
        plain = text.encode()
        digits = len(plain) - len(plain.translate(None, _ASCII_DIGITS))
        symbols = visible - (len(plain) - len(plain.translate(None, _ASCII_ALNUM)))
        vowels = len(plain) - len(plain.translate(None, _ASCII_VOWELS))
    else:
        digits = len(_DIGIT.findall(text))
        symbols = visible - len(_NO_ALNUM.sub("", text))
        vowels = len(_VOWEL.findall(low))
    hits = sum(counts[w] for w in words.by.get(language or "", ()) if w in counts)
    return {
        "language": language,
        "n_lines": len(lines),
        "n_words": n_words,
        "mean_word_chars": letters / n_words if n_words else 0.0,
        "symbol_share": symbols / visible,
        "digit_share": digits / visible,
        "punct_line_share": ended / max(n_full, 1),
        "common_share": words.cjk_chars(text) / cjk if language in words.cjk_languages and cjk else (hits / n_words if n_words else 0.0),
        "distinct_word_share": len(counts) / n_words if n_words else 0.0,
        "vowel_share": vowels / max(visible - symbols - digits, 1),
        "sentence_share": inside / visible,
    }


_FIELDS = "language string, n_lines int, n_words int, mean_word_chars double, symbol_share double, digit_share double, punct_line_share double, common_share double, distinct_word_share double, vowel_share double, sentence_share double"


def document_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its id, ``recorded`` (its language tag in one
    spelling), ``has_text`` and the statistics, which are null where a text is
    null, empty or blank. Texts are read whole.

    Equal rows stay equal rows; other columns are ignored; an empty table gives
    an empty result; without common words their share is 0 everywhere.
    """
    if not under(common_words, MOST_COMMON_WORDS):
        raise ValueError("too many common words to send to all workers")
    listed = [(r[0], r[1]) for r in common_words.select("lang", "word").distinct().collect()]
    tag = F.lower(F.trim(F.col(lang_col)))
    named = F.create_map(*[F.lit(x) for kv in LANGUAGE_TAGS.items() for x in kv])
    recorded = F.coalesce(named[tag], F.substring(tag, 1, 2))
    source = docs.select(F.col(id_col).alias("id"), recorded.alias("recorded"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in _FIELDS.split(", ")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(listed)
        for pdf in batches:
            rows = [text_statistics(t, words) if isinstance(t, str) and t.strip() else None for t in pdf["text"]]
            out = pd.DataFrame([r or {} for r in rows], columns=names)
            out.insert(0, "has_text", [r is not None for r in rows])
            out.insert(0, "recorded", pdf["recorded"].tolist())
            out.insert(0, "id", pdf["id"])
            for c in ("n_lines", "n_words"):
                out[c] = out[c].astype("Int32")
            for c in ("recorded", "language"):
                out[c] = out[c].astype(object)
            yield out

    return spread(source).mapInPandas(measure, f"id {kind}, recorded string, has_text boolean, {_FIELDS}").withColumnRenamed("id", id_col)


def language_references(stats: DataFrame) -> DataFrame:
    """Per language, of each statistic in TAILS the place of prose and its
    spread, from KLL sketches: ``NAME_at`` and ``NAME_spread``.

    Only documents that pass the sentence test count. The place is their
    median, the spread the distance between their quartiles, brought to a
    standard deviation. A language without such documents has no row."""
    known = stats.where(F.col("has_text") & (F.col("sentence_share") >= PROSE_SHARE)).withColumn("group", F.coalesce("language", "recorded", F.lit("")))
    sketched = known.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c, SKETCH_SIZE).alias(c) for c in TAILS])
    out = [F.col("group"), F.col("n")]
    for c, (_, least) in TAILS.items():
        low, at, high = (F.kll_sketch_get_quantile_double(F.col(c), F.lit(x)) for x in (0.25, 0.5, 0.75))
        out += [at.alias(f"{c}_at"), F.greatest((high - low) / 1.349, F.lit(least)).alias(f"{c}_spread")]
    return sketched.select(*out)


def tail_flags(stats: DataFrame) -> DataFrame:
    """Adds to each document with text ``NAME_z``, robust z-scores that are
    positive away from prose, ``in_tail`` and ``odd_words``, which is true where
    all statistics in OF_WORDS are far out. The references have one row per
    language; documents meet them by a join on it. Where a language has none,
    z-scores are null and no statistic is in a tail."""
    known = stats.where("has_text").withColumn("group", F.coalesce("language", "recorded", F.lit("")))
    every = language_references(stats)
    joined = known.join(F.broadcast(every) if under(every, 10_000) else every, "group", "left")
    z = {c: (F.col(f"{c}_at") - F.col(c) if side == "high" else F.col(c) - F.col(f"{c}_at")) / F.col(f"{c}_spread") for c, (side, _) in TAILS.items()}
    joined = joined.withColumns({f"{c}_z": x for c, x in z.items()})
    low = F.col("language").isNull() | F.coalesce(F.greatest(*[F.col(f"{c}_z") for c in TAILS]) >= TAIL, F.lit(False))
    odd = F.coalesce(reduce(and_, [F.col(f"{c}_z") >= FAR for c in OF_WORDS]), F.lit(False))
    return joined.withColumns({"in_tail": low, "odd_words": odd}).drop("group", "n", *[f"{c}_{x}" for c in TAILS for x in ("at", "spread")])


def not_prose(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents with a visible character whose text isn't natural prose, with
    their z-scores and flags: those of which less than PROSE_SHARE of the
    visible characters stand inside sentences, and those that pass this test
    with words that are far from the prose of their language (``odd_words``).
    The references are of documents that pass, so that it doesn't matter how
    many of a language are tables or code."""
    flagged = tail_flags(durable(document_statistics(docs, common_words, id_col, text_col, lang_col)))
    return flagged.where((F.col("sentence_share") < PROSE_SHARE) | F.col("odd_words"))
