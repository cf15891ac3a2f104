"""Generated, minified and vendored source files.

Repositories may declare in attribute files which paths are generated or
vendored. For the others, equivalent path patterns are mined: a directory name
or name ending counts if nearly all files that have it, over several projects,
show that nobody wrote them there, by their content (a generator's notice, an
upstream notice, minified code, data, or the same code in other projects) or,
among projects with attribute files, by what these declare.
Patterns that are common knowledge complete the mined ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sourceloom.functions.lexing import CLOSERS, COMMENT, ID, LANGUAGE_OF, NUM, OP, OPENERS, STR, extension, lex
from sourceloom.llm.attributes import declared, parse_attributes
from sourceloom.session import durable, spread, under

#: Directories and name endings of files that tools write or that
#: come from elsewhere, as public conventions have them.
GENERATED_DIRS = set("generated __generated__ gen autogen codegen".split())
VENDORED_DIRS = set("vendor _vendor vendored third_party third-party thirdparty node_modules bower_components extern external externals deps site-packages jspm_packages".split())
BUILT_DIRS = set("dist".split())
GENERATED_NAMES = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|dart)|_grpc\.pb\.go|\.(?:gen|generated|g|auto)\.[a-z]+|[._-]?Generated\.(?:java|kt|cs)|_generated\.[a-z]+|\.designer\.cs|_string\.go|zz_generated\.\w+\.go|_gen\.go|\.freezed\.dart|OuterClass\.java|Grpc\.java)$")
BUILT_NAMES = re.compile(r"(?:[.-](?:min|bundle|chunk|umd|iife)\.(?:m?js|css)|\.[0-9a-f]{8,20}\.(?:m?js|css))$")

#: Notices of generators, and of upstream projects, as a line of
#: comment says them.
_GENERATED_NOTICE = re.compile(
    r"""^\W*(?:code\s+generated\s+(?:by|from)\b.*|.*@generated\b.*|</?auto-?generated\b.*|(?:this\s+(?:file|code|class|module)\s+(?:is|was|has\s+been)\s+)?(?:automatically|auto)[-\s]?generated(?:\s+(?:file|code|by|from|with|using)\b.*|\W*(?:do\s+not\s+(?:edit|modify|change).*)?)|
    (?:this\s+(?:file|code|class|module)\s+(?:is|was|has\s+been)\s+)?generated\s+(?:by|from|with|using)\s+(?:the\s+)?[\w./-]+.*(?:do\s+not|don't)\s+(?:edit|modify|change)\b.*|(?:this\s+(?:file|code)\s+(?:is|was|has\s+been)\s+)generated\s+(?:by|from|with|using)\b.*)$""",
    re.I | re.X,
)
_MADE_NOTICE = re.compile(
    r"""^\W*(?:(?:this|the)\s+(?:file|code|class|module|source|package)\s+(?:is|was|has\s+been)\s+)?(?:(?:automatically|machine)[-\s]+)?(?:produced|created|emitted|written|compiled|built|rendered|generated|exported|assembled|output)\s+(?:by|from|with|using)\s+(?!hand\b|humans?\b|us\b|me\b)[\w./@-]+.*
    \b(?:(?:changes|edits|modifications)\b.*\b(?:lost|overwritten|discarded|replaced|reverted)|(?:do\s+not|don't|never)\s+(?:edit|modify|change|touch)|(?:edit|change|modify)\b.*\binstead)\b""",
    re.I | re.X,
)
_UPSTREAM_NOTICE = re.compile(
    r"""(?:\bcopied\s+(?:verbatim\s+)?from\s+[\w.@/-]+\s+v?\d+\.\d+|\bvendored\s+from\b|\bkept\s+as\s+is\s+upstream\b|^\W*upstream:\s*https?://|\(c\)\s+(?:\d{4}\s+)?the\s+[\w.-]+\s+authors\b.*|^\W*[\w.@/-]+\s+v\d+\.\d+\.\d+\W*$|^/\*!\s*[\w.@/-]+\s+v?\d+\.\d+|\bthis\s+is\s+a\s+copy\s+of\s+[\w.-]+\s+v?\d+\.\d+)""",
    re.I | re.X,
)

_DIGITS = re.compile(r"\d+")

#: A pattern is mined from so many files of so many projects at least, if so
#: large a share of them shows it by content.
MINED_FILES, MINED_PROJECTS, MINED_SHARE = 8, 3, 0.9

#: So many declarations of one shape at least, numbered one after the other,
#: that make up so large a share of the code, are written by a tool.
TEMPLATE_REPEATS, TEMPLATE_SHARE = 8, 0.7

#: Tokens from which equal code in several projects counts as a copy.
COPY_TOKENS = 40

#: One key in so many rows is split off as hot.
HOT_ONE_IN = 5000


def content_evidence(path: str, content: str | None) -> tuple[list[str], int | None]:
    """What the content of a file shows, and a hash of its code without
    comments and blanks (null for short ones)."""
    text = content or ""
    if not text.strip():
        return [], None
    language = LANGUAGE_OF.get(extension(path), "javascript")
    tokens = lex(language, text).tokens
    code = [t for t in tokens if t[0] != COMMENT]
    found = []
    lines_of_code = 0
    head = True
    last = -1
    for kind, word, at in tokens:
        if kind != COMMENT:
            head = head and lines_of_code < 3
            if at > last:
                end = text.find("\n", at)
                last = len(text) if end < 0 else end
                lines_of_code += 1
            continue
        for line in word.split("\n"):
            line = line.strip().strip("\r")
            if len(line) < 300 and (_GENERATED_NOTICE.match(line.strip("/*# \t!;-")) or _MADE_NOTICE.match(line)):
                found.append("generated")
            elif head and len(line) < 300 and (_UPSTREAM_NOTICE.search(line) or _UPSTREAM_NOTICE.search(line.strip("/*# \t!;-"))):
                found.append("vendored")
    if is_minified(text, code):
        found.append("minified")
    elif is_templated(code):
        found.append("generated")
    if is_data(text, code):
        found.append("data")
    digest = xxh64_intdigest(" ".join(t[1] for t in code).replace("\r", "")) - 2**63 if len(code) >= COPY_TOKENS else None
    return sorted(set(found)), digest


def is_minified(text: str, code: list) -> bool:
    """Whether most code, strings aside, stands in long lines of short names
    with hardly any blanks."""
    if len(code) < 60 or max(map(len, text.split("\n"))) < 149:
        return False
    per_line: dict[int, int] = {}
    ends, line, at = [], 0, text.find("\n")
    while at >= 0:
        ends.append(at)
        at = text.find("\n", at + 1)
    names, letters, total = 0, 0, 0
    for kind, word, offset in code:
        while line < len(ends) and ends[line] < offset:
            line += 1
        n = len(word) if kind != STR else 2
        per_line[line] = per_line.get(line, 0) + n
        total += n
        if kind == ID:
            names += 1
            letters += len(word)
    dense = sum(n for n in per_line.values() if n >= 150)
    if dense < 0.7 * total or not names:
        return False
    blanks = 1 - total / max(1, total + sum(c.isspace() for c in text))
    tight = sum(b[2] == a[2] + len(a[1]) for a, b in zip(code, code[1:])) / len(code)
    return tight > 0.7 and (letters / names < 5 or blanks < 0.1)


def is_templated(code: list) -> bool:
    """Whether most of the code is one shape that is repeated under names which
    differ by a running number only, as tools write it from a template."""
    at: dict[str, dict[int, int]] = {}
    for k, (kind, word, _) in enumerate(code):
        if kind == ID and word[-1].isdecimal():
            stem = word.rstrip("0123456789")
            if stem and 0 < len(word) - len(stem) < 10:
                at.setdefault(stem, {}).setdefault(int(word[len(stem) :]), k)
    for numbers in at.values():
        if len(numbers) < TEMPLATE_REPEATS:
            continue
        starts = [numbers[x] for x in sorted(numbers) if x - 1 in numbers or x + 1 in numbers]
        shapes: dict[tuple, int] = {}
        for a, b in zip(starts, starts[1:]):
            if a < b:
                shape = tuple(kind if kind == NUM else _DIGITS.sub("0", word) for kind, word, _ in code[a:b])
                shapes[shape] = shapes.get(shape, 0) + 1
        shape, times = max(shapes.items(), key=lambda x: x[1] * len(x[0]), default=((), 0))
        if times + 1 >= TEMPLATE_REPEATS and (times + 1) * len(shape) >= TEMPLATE_SHARE * len(code) and len(shape) > 4:
            return True
    return False


def is_data(text: str, code: list) -> bool:
    """Whether literals in lists, or encoded text, make up nearly the whole
    file: at least nine tenths of its visible characters, comments aside."""
    if not code:
        return False
    visible = literal = elements = encoded = 0
    depth = 0
    for kind, word, _ in code:
        if kind == OP:
            visible += len(word)
            if word in OPENERS:
                depth += 1
            elif word in CLOSERS:
                depth -= 1
            elif depth and word in (",", "-", ":"):
                literal += 1
        elif kind == STR:
            n = len("".join(word.split()))
            visible += n
            if depth > 0 and len(word) > 2:
                literal += n
                elements += 1
            elif n >= 200 and n >= 0.97 * len(word):
                encoded += n
        else:
            visible += len(word)
            if kind == NUM and depth > 0:
                literal += len(word)
                elements += 1
    return elements >= 24 and literal >= 0.85 * visible or encoded >= 0.85 * visible and encoded >= 400


def path_evidence(path: str) -> list[str]:
    """What the public conventions say about a path."""
    *dirs, name = (path or "").split("/")
    lower = [d.lower() for d in dirs]
    out = []
    if any(d in GENERATED_DIRS for d in lower) or GENERATED_NAMES.search(name):
        out.append("generated")
    if any(d in VENDORED_DIRS for d in lower):
        out.append("vendored")
    if any(d in BUILT_DIRS for d in lower) or BUILT_NAMES.search(name):
        out.append("minified")
    return out


def _join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of rows with keyed, one row per key, of which weight says how
    many rows have it: hot keys are few and broadcast, the rest is shuffled."""
    hot_from = max(total // HOT_ONE_IN, 1)
    hot, cool = keyed.where(F.col(weight) > hot_from).drop(weight), keyed.where(F.col(weight) <= hot_from).drop(weight)
    if not under(hot, 4 * HOT_ONE_IN):
        return rows.join(keyed.drop(weight), key, "left")
    on_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti") if not hot.isEmpty() else rows
    return on_hot.unionByName(rest.join(cool, key, "left"))


def file_evidence(sources: DataFrame) -> DataFrame:
    """Per source file, repeats dropped once the contents are gone: ``file_id``, ``project``, ``path``, ``shown``
    (by its content), ``named`` (by the conventions) and ``code_hash``."""
    files = spread(sources.select("file_id", "project", "path", "content").where("path IS NOT NULL"))
    kind = files.schema["file_id"].dataType.simpleString()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [content_evidence(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(
                {"file_id": pdf["file_id"], "project": pdf["project"].tolist(), "path": pdf["path"].tolist(), "shown": [s for s, _ in seen], "named": [path_evidence(p) for p in pdf["path"]], "code_hash": pd.array([h for _, h in seen], dtype="Int64")}
            )

    return files.mapInPandas(look, f"file_id {kind}, project string, path string, shown array<string>, named array<string>, code_hash bigint").distinct()


def declared_marks(sources: DataFrame) -> DataFrame:
    """Per project that has attribute files: ``rules`` of all of them."""
    holders = sources.where(F.col("path").rlike(r"(?:^|/)\.gitattributes$")).select("project", "path", "content").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[pr, *rule] for pr, p, c in zip(pdf["project"], pdf["path"], pdf["content"]) for rule in parse_attributes(p, c)]
            yield pd.DataFrame(rows, columns=["project", "regex", "name", "is_on", "depth", "line"])

    rules = holders.mapInPandas(read, "project string, regex string, name string, is_on boolean, depth int, line int")
    return rules.groupBy("project").agg(F.collect_list(F.struct("regex", "name", "is_on", "depth", "line")).alias("rules"))


def copied_code(files: DataFrame) -> DataFrame:
    """Code hashes that occur in several projects, ``n`` rows each, if a copy
    is vendored by name or notice, or if many projects have it."""
    vendored = F.max((F.array_contains("named", "vendored") | F.array_contains("shown", "vendored")).cast("int"))
    each = files.where("code_hash IS NOT NULL").groupBy("code_hash", "project").agg(F.count(F.lit(1)).alias("n"), vendored.alias("v"))
    counted = each.groupBy("code_hash").agg(F.sum("n").alias("n"), F.count("project").alias("projects"), F.max("v").alias("v"))
    return counted.where("n > 1 AND (v = 1 OR projects >= 4)").select("code_hash", "n", F.lit(True).alias("copied"))


def with_declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds to files what their project's attribute files say: ``has_rules``,
    and ``generated`` and ``vendored``, null where nothing is said."""
    if rules.isEmpty():
        return files.withColumns({"has_rules": F.lit(False), **{c: F.lit(None).cast("boolean") for c in ("generated", "vendored")}})
    joined = files.join(F.broadcast(rules) if under(rules, 20_000) else rules, "project", "left")
    ruled = joined.where("rules IS NOT NULL")

    def say(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [declared(r.path, [(x["regex"], x["name"], x["is_on"], x["depth"], x["line"]) for x in r.rules]) for r in pdf.itertuples()]
            out = pdf[["file_id", "project", "path"]].copy()
            out["generated"] = pd.array([x.get("linguist-generated") for x in said], dtype="boolean")
            out["vendored"] = pd.array([x.get("linguist-vendored") for x in said], dtype="boolean")
            yield out

    kind = files.schema["file_id"].dataType.simpleString()
    said = ruled.select("file_id", "project", "path", "rules").distinct().mapInPandas(say, f"file_id {kind}, project string, path string, generated boolean, vendored boolean")
    return files.join(said.withColumn("has_rules", F.lit(True)), ["file_id", "project", "path"], "left").withColumn("has_rules", F.coalesce("has_rules", F.lit(False)))


def mined_patterns(files: DataFrame) -> DataFrame:
    """Directory names and name endings that nearly only files have whose
    content or copies show that they aren't hand-written: ``pattern``. So too
    such that nearly only such or declared files have in the projects with
    attribute files, as the other projects can't declare theirs."""
    parts = F.split("path", "/")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(d, F.lit("/")))
    ending = F.regexp_extract(F.element_at(parts, -1), r"(\.[A-Za-z]{2,9}\.[A-Za-z]+|_[a-z]+\d\.[a-z]+)$", 1)
    patterns = F.array_distinct(F.concat(dirs, F.array(ending)))
    evident = (F.size("shown") > 0) | F.coalesce("copied", F.lit(False))
    known = "has_rules" in files.columns
    ruled = F.col("has_rules") if known else F.lit(False)
    said = F.coalesce(F.col("generated") | F.col("vendored"), F.lit(False)) if known else F.lit(False)
    seen = files.select(F.explode(patterns).alias("pattern"), "project", (evident | said).cast("int").alias("e"), ruled.alias("ruled")).where("pattern <> ''")
    each = seen.groupBy("pattern", "project").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"), F.max("ruled").alias("ruled"))

    def enough(among: DataFrame) -> DataFrame:
        counted = among.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.count("project").alias("projects"))
        return counted.where((F.col("n") >= MINED_FILES) & (F.col("projects") >= MINED_PROJECTS) & (F.col("e") >= MINED_SHARE * F.col("n"))).select("pattern")

    return enough(each).unionByName(enough(each.where("ruled"))).distinct() if known else enough(each)


def not_handwritten(sources: DataFrame) -> DataFrame:
    """The files that nobody wrote by hand in their project: ``file_id``,
    ``project``, ``path`` and ``reasons`` (generated, minified, vendored, data,
    copied, mined).

    An attribute file of the project overrules names and mined patterns: what
    it sets is a reason, what it unsets takes that reason away; content still
    counts. Null paths give no row; null or empty contents show nothing, so
    that only their path may tell. Repeated rows count once, other columns are
    ignored, an empty table gives an empty result. Copies are compared as whole
    code without comments and blanks.
    """
    files = durable(file_evidence(sources))
    total = files.count()
    copies = durable(copied_code(files))
    rules = durable(declared_marks(sources))
    marked = durable(with_declared(_join_hot(files, copies, "code_hash", "n", total), rules))
    patterns = durable(mined_patterns(marked if not rules.isEmpty() else marked.drop("has_rules")))
    parts = F.split("path", "/")
    name_ending = F.regexp_extract(F.element_at(parts, -1), r"(\.[A-Za-z]{2,9}\.[A-Za-z]+|_[a-z]+\d\.[a-z]+)$", 1)
    components = F.array_distinct(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(d, F.lit("/"))), F.array(name_ending)))
    hits = marked.select("file_id", "project", "path", F.explode(components).alias("pattern"))
    few = under(patterns, 100_000)
    by_pattern = hits.join(F.broadcast(patterns) if few else patterns, "pattern", "left_semi").select("file_id", "project", "path").distinct().withColumn("mined", F.lit(True))
    joined = marked.join(by_pattern, ["file_id", "project", "path"], "left")
    kind = files.schema["file_id"].dataType.simpleString()

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                generated, vendored = ((None if pd.isna(x) else bool(x)) for x in (r.generated, r.vendored))
                reasons = set(r.shown)
                by_name = set(r.named) | ({"mined"} if r.mined is True else set())
                if generated is False:
                    by_name -= {"generated", "minified", "mined"}
                if vendored is False:
                    by_name -= {"vendored", "mined"}
                reasons |= by_name
                if generated:
                    reasons.add("generated")
                if vendored:
                    reasons.add("vendored")
                if r.copied is True:
                    reasons.add("copied")
                if reasons:
                    rows.append([r.file_id, r.project, r.path, sorted(reasons)])
            yield pd.DataFrame(rows, columns=["file_id", "project", "path", "reasons"])

    return joined.select("file_id", "project", "path", "shown", "named", "mined", "copied", "generated", "vendored").mapInPandas(decide, f"file_id {kind}, project string, path string, reasons array<string>")
