"""Symbols and imports of source files.

Python files are parsed by the standard parser; files that it rejects, and the
other languages, are scanned by their tokens at depth zero. A file of a
language without a scanner keeps its row and has no symbols.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.lexing import CLOSERS, COMMENT, ID, OP, OPENERS, STR, extension, lex, line_of, line_starts
from sourceloom.functions.text import newline_count
from sourceloom.session import spread

#: The languages of the scan, and the size in bytes above which a
#: file keeps its row only.
SCAN_LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java"}
PARSE_BYTES = 512_000

SYMBOLS = "project string, path string, ord int, parent_ord int, name string, kind string, line int, signature string"
IMPORTS = "project string, path string, ord int, module string, names array<string>, line int"

#: (name, kind, line, signature, children) and (module, names, line).
Found = tuple[list[tuple], list[tuple]]


def _import_names(text: str) -> list[str]:
    return [n.strip() for n in text.split(",")]


def python_found(source: str) -> Found:
    """Top-level functions and classes with their methods, and imports.
    Decorated classes are left out; async functions show as def."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_scan(source)
    encoded = source.encode().split(b"\n")

    def cut(node) -> str:
        rows = encoded[node.lineno - 1 : node.end_lineno]
        if len(rows) == 1:
            return rows[0][node.col_offset : node.end_col_offset].decode(errors="replace")
        rows = [rows[0][node.col_offset :], *rows[1:-1], rows[-1][: node.end_col_offset]]
        return b"\n".join(rows).decode(errors="replace")

    def function(node, kind: str) -> tuple:
        head = cut(node)
        m = re.match(rf"(?:async\s+)?def\s+{re.escape(node.name)}\s*(?:\[[^\]]*\]\s*)?", head)
        end = _closing(head, m.end())
        returned = f" -> {cut(node.returns)}" if node.returns else ""
        return (node.name, kind, node.lineno, f"def {node.name}{head[m.end() : end]}{returned}", [])

    symbols, imports = [], []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [(p.strip(), [], node.lineno) for p in cut(node).replace("import ", "").split(",")]
        elif isinstance(node, ast.ImportFrom):
            module, joined, names = cut(node).partition(" import ")
            if joined:
                imports.append((module.replace("from ", "").strip(), _import_names(names), node.lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(function(node, "function"))
        elif isinstance(node, ast.ClassDef) and not node.decorator_list:
            head = cut(node)
            m = re.match(rf"class\s+{re.escape(node.name)}\s*", head)
            bases = head[m.end() : _closing(head, m.end())] if head[m.end() : m.end() + 1] == "(" else ""
            methods = [function(x, "method") for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            symbols.append((node.name, "class", node.lineno, f"class {node.name}{bases}", methods))
    return symbols, imports


def _closing(text: str, at: int) -> int:
    """The offset behind the bracket that closes the one at an offset."""
    depth = 0
    for kind, word, offset in lex("python", text[at:], None, False).tokens:
        if kind == OP:
            depth += (word in OPENERS) - (word in CLOSERS)
            if not depth:
                return at + offset + 1
    return len(text)


def _python_scan(source: str) -> Found:
    """What lines at the margin and one step in declare, for broken files."""
    symbols, imports = [], []
    tokens = lex("python", source).tokens
    inside = {line for kind, word, at in tokens if kind == STR for line in range(source.count("\n", 0, at) + 1, source.count("\n", 0, at + len(word)) + 1)}
    decorated = False
    for number, line in enumerate(source.split("\n")):
        if number in inside:
            continue
        if line.startswith("@"):
            decorated = True
            continue
        m = re.match(r"(\s*)(?:async\s+)?def\s+(\w+)\s*(\(.*\))?(\s*->\s*[^:]+)?", line)
        if m:
            found = (m[2], "method" if m[1] else "function", number + 1, f"def {m[2]}{m[3] or '()'}{' -> ' + m[4].split('->', 1)[1].strip() if m[4] else ''}", [])
            if not m[1]:
                symbols.append(found)
            elif symbols and symbols[-1][1] == "class" and len(m[1].expandtabs(4)) == 4:
                symbols[-1][4].append(found)
        m = re.match(r"class\s+(\w+)\s*(\([^)]*\))?", line)
        if m and not decorated:
            symbols.append((m[1], "class", number + 1, f"class {m[1]}{m[2] or ''}", []))
        m = re.match(r"from\s+(\S+)\s+import\s+(.+)", line)
        if m:
            imports.append((m[1], _import_names(m[2]), number + 1))
        elif re.match(r"import\s", line):
            imports += [(p.strip(), [], number + 1) for p in line[7:].split(",")]
        if line.strip():
            decorated = False
    return symbols, imports


class _Scan:
    """Tokens of a file without comments, with their brackets paired."""

    def __init__(self, language: str, source: str):
        self.source = source
        self.starts = line_starts(source)
        self.t = [t for t in lex(language, source).tokens if t[0] != COMMENT]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, (kind, word, _) in enumerate(self.t):
            if kind == OP and word in OPENERS:
                stack.append(k)
            elif kind == OP and word in CLOSERS and stack:
                self.pair[stack.pop()] = k
        for k in stack:
            self.pair[k] = len(self.t) - 1

    def word(self, k: int) -> str:
        return self.t[k][1] if 0 <= k < len(self.t) else ""

    def kind(self, k: int) -> str:
        return self.t[k][0] if 0 <= k < len(self.t) else ""

    def line(self, k: int) -> int:
        return line_of(self.starts, self.t[k][2]) + 1

    def text(self, a: int, b: int) -> str:
        """Source from token a to token b, both included."""
        return self.source[self.t[a][2] : self.t[b][2] + len(self.t[b][1])] if a <= b < len(self.t) else ""

    def top(self, first: int = 0, last: int | None = None) -> Iterator[int]:
        """Tokens between two places that are in no bracket there; openers
        count, what they hold is skipped."""
        k, last = first, len(self.t) if last is None else last
        while k < last:
            yield k
            k = self.pair[k] + 1 if k in self.pair else k + 1

    def params(self, k: int) -> tuple[str, int]:
        """The parenthesised text at k, type parameters skipped, and its end."""
        if self.word(k) == "<":
            depth = 0
            while k < len(self.t):
                depth += self.word(k).count("<") - (self.word(k).count(">") if self.word(k) not in ("=>", "->") else 0)
                k += 1
                if depth <= 0:
                    break
        if self.word(k) == "(":
            end = self.pair[k]
            return self.text(k, end), end
        return "()", k - 1


def script_found(language: str, source: str) -> Found:
    """Functions, exported functions, classes with methods, and constants that
    are arrow functions; other exports yield nothing."""
    s = _Scan(language, source)
    symbols, imports = [], []
    begins, exported = True, False
    depth_zero = list(s.top())
    for n, k in enumerate(depth_zero):
        word = s.word(k)
        before = s.word(k - 1)
        fresh = k == 0 or before in (";", "}") or s.line(k) > s.line(k - 1)
        exported = exported and not fresh or word == "export" and fresh
        begins = fresh or before in ("export", "async", "default")
        if word == "import" and fresh and s.word(k + 1) not in ("(", "."):
            end = k
            while end + 1 < len(s.t) and s.word(end) != ";" and not (s.kind(end) == STR and s.line(end + 1) > s.line(end)):
                end += 1
            text = s.text(k, end).rstrip(";")
            left, joined, module = text.rpartition(" from ")
            if joined:
                names = left.split(" from ")[0].replace("import", "").strip().strip("{} ")
                imports.append((module.strip().strip("'\""), _import_names(names) if names else [], s.line(k)))
            else:
                imports.append((text.replace("import", "").strip().strip("'\""), [], s.line(k)))
        elif word == "function" and begins and s.kind(k + 1) == ID:
            params, _ = s.params(k + 2)
            line = s.line(k - 1) if before == "async" else s.line(k)
            symbols.append((s.word(k + 1), "function", line, f"function {s.word(k + 1)}{params}", []))
        elif word == "class" and begins and not exported and s.kind(k + 1) == ID:
            body = next((m for m in depth_zero[n:] if s.word(m) == "{"), None)
            methods = _script_methods(s, body) if body is not None else []
            symbols.append((s.word(k + 1), "class", s.line(k), f"class {s.word(k + 1)}", methods))
        elif word in ("const", "let") and begins and not exported and s.kind(k + 1) == ID:
            arrow = _arrow(s, k + 2)
            if arrow:
                symbols.append((s.word(k + 1), "function", s.line(k), f"const {s.word(k + 1)} = {arrow} =>", []))
    return symbols, imports


def _arrow(s: _Scan, k: int) -> str | None:
    """The parameters of an arrow function that is the value at k."""
    if s.word(k) == ":":
        while k < len(s.t) and s.word(k) not in ("=", ";"):
            k = s.pair[k] + 1 if k in s.pair else k + 1
    if s.word(k) != "=":
        return None
    k += 1
    if s.word(k) == "async":
        k += 1
    if s.kind(k) == ID and s.word(k + 1) == "=>":
        return "()"
    if s.word(k) in ("(", "<"):
        params, end = s.params(k)
        m = end + 1
        if s.word(m) == ":":
            while m < len(s.t) and s.word(m) not in ("=>", ";", "{", "}"):
                m = s.pair[m] + 1 if m in s.pair and s.word(m) != "{" else m + 1
        return params if s.word(m) == "=>" else None
    return None


def _script_methods(s: _Scan, body: int) -> list[tuple]:
    methods = []
    last = s.pair[body]
    for k in s.top(body + 1, last):
        opens = s.word(k) == "(" and s.kind(k - 1) == ID and (k - 2 == body or s.word(k - 2) in ("}", ";", "async", "static", "get", "set", "*", "public", "private", "protected", "override", "readonly", "abstract") or s.line(k - 2) < s.line(k - 1))
        if opens:
            end = s.pair[k]
            after = end + 1
            if s.word(after) == ":":
                while after < last and s.word(after) not in ("{", ";"):
                    after += 1
            if s.word(after) == "{":
                start = k - 1
                while start - 1 > body and s.word(start - 1) in ("async", "static", "get", "set", "*", "public", "private", "protected", "override") and s.line(start - 1) == s.line(start):
                    start -= 1
                methods.append((s.word(k - 1), "method", s.line(start), f"{s.word(k - 1)}{s.text(k, end)}", []))
    return methods


def go_found(source: str) -> Found:
    """Functions, methods with their receivers, types, and imports."""
    s = _Scan("go", source)
    symbols, imports = [], []
    for k in s.top():
        fresh = k == 0 or s.word(k - 1) in (";", "}", ")") or s.line(k) > s.line(k - 1)
        if not fresh:
            continue
        if s.word(k) == "import":
            inner = range(k + 2, s.pair[k + 1]) if s.word(k + 1) == "(" else range(k + 1, min(k + 3, len(s.t)))
            for m in inner:
                if s.kind(m) == STR:
                    named = s.kind(m - 1) == ID and s.word(m - 1) != "import" and s.line(m - 1) == s.line(m)
                    imports.append((s.word(m).strip('"`'), [], s.line(m - 1 if named else m)))
                    if s.word(k + 1) != "(":
                        break
        elif s.word(k) == "func" and s.kind(k + 1) == ID:
            m = k + 2
            if s.word(m) == "[":
                m = s.pair[m] + 1
            symbols.append((s.word(k + 1), "function", s.line(k), f"func {s.word(k + 1)}{s.params(m)[0]}", []))
        elif s.word(k) == "func" and s.word(k + 1) == "(":
            end = s.pair[k + 1]
            if s.kind(end + 1) == ID:
                symbols.append((s.word(end + 1), "method", s.line(k), f"func {s.text(k + 1, end)} {s.word(end + 1)}{s.params(end + 2)[0]}", []))
        elif s.word(k) == "type":
            if s.word(k + 1) == "(":
                at = [m for m in s.top(k + 2, s.pair[k + 1]) if s.kind(m) == ID and s.line(m) > s.line(m - 1)]
            else:
                at = [k + 1]
            for m in at:
                shape = m + 1
                if s.word(shape) == "[" and s.kind(shape + 1) == ID and s.word(shape + 2) != "]":
                    shape = s.pair[shape] + 1
                if s.word(shape) == "=":
                    continue
                sort = {"struct": "struct", "interface": "interface", "map": "map", "func": "function", "[": "slice", "*": "pointer", "chan": "channel"}.get(s.word(shape), "qualified" if s.word(shape + 1) == "." else "type_identifier")
                if s.word(shape) == "[" and s.word(shape + 1) != "]":
                    sort = "array"
                kind = sort if sort in ("struct", "interface") else "class"
                symbols.append((s.word(m), kind, s.line(m), f"type {s.word(m)} {'type_identifier'.replace('_type', '') if sort == 'type_identifier' else sort}", []))
    return symbols, imports


def rust_found(source: str) -> Found:
    """Functions, structs, methods of impl blocks (as rows of their own), uses."""
    s = _Scan("rust", source)
    symbols, imports = [], []

    def first(k: int) -> int:
        """The token where an item with modifiers begins."""
        while k > 0 and (s.word(k - 1) in ("pub", "async", "unsafe", "const", "extern", "default") or s.word(k - 1) == ")" and s.word(k - 4) == "pub"):
            k = k - 4 if s.word(k - 1) == ")" else k - 1
        return k

    for k in s.top():
        word = s.word(k)
        if word == "use" and s.word(k - 1) != ".":
            end = next((m for m in s.top(k) if s.word(m) == ";"), len(s.t) - 1)
            start = first(k)
            imports.append((s.text(start, end).rstrip(";").replace("use ", "").strip(), [], s.line(start)))
        elif word == "fn" and s.kind(k + 1) == ID:
            params, end = s.params(k + 2)
            returned = _rust_return(s, end + 1)
            symbols.append((s.word(k + 1), "function", s.line(first(k)), f"fn {s.word(k + 1)}{params}{returned}", []))
        elif word == "struct" and s.kind(k + 1) == ID:
            symbols.append((s.word(k + 1), "struct", s.line(first(k)), f"struct {s.word(k + 1)}", []))
        elif word == "impl" and (k == 0 or s.word(k - 1) in ("}", ";", "]", "unsafe", "default")):
            body = next((m for m in s.top(k) if s.word(m) == "{"), None)
            if body is None:
                continue
            start = k + 1
            if s.word(start) == "<":
                depth = 0
                while start < body:
                    depth += s.word(start).count("<") - (s.word(start).count(">") if s.word(start) != "->" else 0)
                    start += 1
                    if depth <= 0:
                        break
            stop = next((m for m in range(start, body) if s.word(m) == "where"), body)
            target = next((m + 1 for m in range(start, stop) if s.word(m) == "for"), start)
            name = s.text(target, stop - 1)
            for m in s.top(body + 1, s.pair[body]):
                if s.word(m) == "fn" and s.kind(m + 1) == ID:
                    symbols.append((s.word(m + 1), "method", s.line(first(m)), f"impl {name} :: fn {s.word(m + 1)}{s.params(m + 2)[0]}", []))
    return symbols, imports


def _rust_return(s: _Scan, k: int) -> str:
    if s.word(k) != "->":
        return ""
    end = k + 1
    while end < len(s.t) and s.word(end) not in ("{", ";", "where"):
        end = s.pair[end] + 1 if s.word(end) in ("(", "[") else end + 1
    return f" -> {s.text(k + 1, end - 1)}"


def java_found(source: str) -> Found:
    """Classes with their methods, and imports."""
    s = _Scan("java", source)
    symbols, imports = [], []
    modifiers = set("public protected private abstract static final synchronized native strictfp default sealed".split())

    def first(k: int, low: int) -> int:
        while k > low and (s.word(k - 1) in modifiers or s.kind(k - 1) == ID and s.word(k - 2) == "@"):
            k -= 2 if s.word(k - 2) == "@" else 1
        return k

    for k in s.top():
        if s.word(k) == "import":
            end = next((m for m in s.top(k) if s.word(m) == ";"), len(s.t) - 1)
            imports.append((s.text(k, end).replace("import", "").replace(";", "").strip(), [], s.line(k)))
        elif s.word(k) == "class" and s.kind(k + 1) == ID and s.word(k - 1) != ".":
            body = next((m for m in s.top(k) if s.word(m) == "{"), None)
            methods = []
            if body is not None:
                for m in s.top(body + 1, s.pair[body]):
                    if s.word(m) == "(" and s.kind(m - 1) == ID and s.word(s.pair[m] + 1) in ("{", ";", "throws") and m - 2 > body and (s.kind(m - 2) == ID and s.word(m - 2) not in modifiers | {"new", "return"} or s.word(m - 2) in (">", "]", ">>")):
                        start = m - 2
                        while start > body + 1 and (s.word(start - 1) not in (";", "{", "}") and s.word(start - 1) not in modifiers and not (s.kind(start - 1) == ID and s.word(start - 2) == "@") and s.word(start - 1) != ")"):
                            start -= 1
                        methods.append((s.word(m - 1), "method", s.line(first(start, body + 1)), f"{s.text(start, m - 2)} {s.word(m - 1)}{s.text(m, s.pair[m])}", []))
            symbols.append((s.word(k + 1), "class", s.line(first(k, 0)), f"class {s.word(k + 1)}", methods))
    return symbols, imports


def found_in(path: str, source: str) -> Found:
    """Symbols and imports of one file; none where a file defeats its scanner."""
    language = SCAN_LANGUAGES.get(extension(path))
    try:
        if language == "python":
            return python_found(source)
        if language in ("javascript", "typescript"):
            return script_found(language, source)
        return {"go": go_found, "rust": rust_found, "java": java_found}[language](source) if language else ([], [])
    except (IndexError, KeyError, RecursionError):
        return [], []


def scan_files(files: DataFrame) -> DataFrame:
    """(project, path, language, lines) of files in a scanned language; lines
    is LFs plus one, or just LFs above PARSE_BYTES."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in SCAN_LANGUAGES.items() for x in kv])[ending]
    count = newline_count(F.col("content"))
    return files.select("project", "path", language.alias("language"), F.when(F.octet_length("content") > PARSE_BYTES, count - 1).otherwise(count).alias("lines")).where("language IS NOT NULL")


def _table(files: DataFrame, schema: str, want_symbols: bool) -> DataFrame:
    small = spread(files.where(F.octet_length("content") <= PARSE_BYTES).select("project", "path", "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, path, content in zip(pdf["project"], pdf["path"], pdf["content"]):
                symbols, imports = found_in(path, content)
                if want_symbols:
                    n = 0
                    for name, kind, line, signature, children in symbols:
                        parent = n
                        rows.append((project, path, n, None, name, kind, line, signature))
                        n += 1
                        for child in children:
                            rows.append((project, path, n, parent, child[0], child[1], child[2], child[3]))
                            n += 1
                else:
                    rows += [(project, path, n, *x) for n, x in enumerate(imports)]
            names = [c.split()[0] for c in schema.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            if want_symbols:
                out["parent_ord"] = out["parent_ord"].astype("Int32")
            yield out

    return small.mapInPandas(run, schema)


def symbols_of(files: DataFrame) -> DataFrame:
    """One row per symbol; ``parent_ord`` is null at top level."""
    return _table(files, SYMBOLS, True)


def imports_of(files: DataFrame) -> DataFrame:
    """One row per import; empty names mean the whole module."""
    return _table(files, IMPORTS, False)
