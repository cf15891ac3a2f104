"""Framework objects found in source lines.

Every extractor takes files (project, path, content) and gives a table. Lines
that match are picked out of each file's line array, and what follows them is
taken from the same array, so that no row has to meet another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import lines

#: The patterns of routes, models, pages, components, stores and
#: calls. \w and \s mean Unicode.
U = "(?U)"
PY_ROUTE = r"""(?i)@\s*(?:\w+)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']"""
PY_DEF = r"(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"
PY_MODEL = r"class\s+(\w+)\s*\(\s*(BaseModel|SQLModel|BaseSettings)\s*(?:,\s*\w+)*\s*\)\s*:"
PY_FIELD = r"^\s{4}(\w+)\s*:\s*(.+?)(?:\s*=.*)?$"
DJANGO_URL = r"""path\s*\(\s*["']([^"']*)["']\s*,\s*(\w[\w.]*)"""
DJANGO_MODEL = r"class\s+(\w+)\s*\(\s*(?:models\.Model|AbstractUser|AbstractBaseUser)\s*\)\s*:"
DJANGO_FIELD = r"^\s{4}(\w+)\s*=\s*models\.(\w+)\s*\("
JS_ROUTE = r"""(?i)(?:\w+)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*["'`]([^"'`]+)["'`]"""
TS_INTERFACE = r"(?:export\s+)?interface\s+(\w+)"
TS_TYPE = r"(?:export\s+)?type\s+(\w+)\s*=\s*\{"
TS_FIELD = r"^\s+(\w+)(\??)\s*:\s*(.+?)\s*;?\s*$"
MONGOOSE = r"""(?:new\s+(?:mongoose\.)?Schema|mongoose\.model)\s*\(\s*["']?(\w+)?"""
JSX_ROUTE = r"""<Route\s+[^>]*path\s*=\s*["']([^"']+)["'][^>]*(?:component\s*=\s*\{(\w+)\}|element\s*=\s*\{?\s*<(\w+))"""
REACT_COMPONENTS = (
    r"(?:export\s+(?:default\s+)?)?function\s+([A-Z]\w+)\s*\(([^)]*)\)",
    r"(?:export\s+(?:default\s+)?)?const\s+([A-Z]\w+)\s*(?::\s*\w+\s*)?=\s*(?:\([^)]*\)|[^=])\s*=>",
    r"class\s+([A-Z]\w+)\s+extends\s+(?:React\.)?(?:Component|PureComponent)",
)
REACT_CALL = r"""(?i)(?:axios|api|http|client|fetch)\s*[\.(]\s*["'`]?(get|post|put|delete|patch)?["'`]?\s*[\(,]\s*["'`]([^"'`]+)["'`]"""
FETCH_CALL = r"""fetch\s*\(\s*["'`]([^"'`]+)["'`]"""
ZUSTAND = r"(?:export\s+)?const\s+(\w+)\s*=\s*create\s*[(<]"
REDUX = r"""createSlice\s*\(\s*\{[^}]*name\s*:\s*["'](\w+)["']"""
VUE_ROUTE = r"""path\s*:\s*["']([^"']+)["']\s*,\s*(?:component|name)\s*:\s*["']?(\w+)"""
VUE_COMPONENT = r"""defineComponent\s*\(\s*\{[^}]*name\s*:\s*["'](\w+)["']"""
VUE_PROPS = r"defineProps\s*[<(]"
PINIA = r"""defineStore\s*\(\s*["'](\w+)["']"""
VUEX = r"(?:new\s+Vuex\.Store|createStore)\s*\("
VUE_CALL = r"""(?i)(?:axios|api|http|client|\$fetch|useFetch)\s*[\.(]\s*["'`]?(get|post|put|delete|patch)?["'`]?\s*[\(,]\s*["'`]([^"'`]+)["'`]"""

FIELD_TYPE = "array<struct<name:string,type:string,required:boolean,description:string>>"
ROUTES = "project string, method string, path string, file string, line int, function_name string, params array<string>, response string"
MODELS = f"project string, name string, file string, line int, kind string, base_class string, fields {FIELD_TYPE}, relationships array<string>"
PAGES = "project string, path string, component_file string, component_name string, line int"
COMPONENTS = "project string, name string, file string, line int, props array<string>, used_in array<string>"
STORES = "project string, name string, file string, line int, kind string, state_fields array<string>, actions array<string>"
CALLS = "project string, method string, path string, file string, line int, function_name string"



def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _ends(files: DataFrame, *suffixes: str) -> DataFrame:
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith(s)
    return files.where(keep)


def matching_lines(files: DataFrame, patterns: list[str], ahead: int = 0) -> DataFrame:
    """project, file, ``line`` (from 1), ``text`` and ``next`` (the following
    lines, up to ``ahead``) of each line that one of the patterns finds."""
    base = files.select("project", F.col("path").alias("file"), "content", lines(F.col("content")).alias("ls"))

    def hit(i):
        out = F.lit(False)
        for p in patterns:
            out = out | F.get("ls", i).rlike(U + p)
        return out

    at = base.where(F.size("ls") > 0).withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.size("ls") - 1), hit)))
    following = F.slice("ls", F.col("i") + 2, F.lit(ahead)) if ahead else _no_strings()
    return at.select("project", "file", (F.col("i") + 1).alias("line"), F.get("ls", F.col("i")).alias("text"), following.alias("next"))


def _group(text, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, U + pattern, n)


def _before_dedent(following: Column) -> Column:
    """Following lines up to the first that leaves the body: neither empty, nor
    indented, nor a comment."""
    left = F.transform(following, lambda x: (x != "") & ~x.rlike(U + r"^\s") & ~x.startswith("#"))
    at = F.array_position(left, True)
    return F.when(at > 0, F.slice(following, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(following)


def _within_braces(following: Column, depth: int) -> Column:
    """Following lines up to the first at whose end the running depth of braces
    is 0 or less, which is left out."""
    empty = F.struct(F.lit(depth).alias("d"), F.lit(False).alias("stop"), _no_strings().alias("out"))

    def step(acc, x):
        d = acc["d"] + F.length(x) - F.length(F.translate(x, "{", "")) - F.length(x) + F.length(F.translate(x, "}", ""))
        stop = acc["stop"] | (d <= 0)
        return F.struct(d.cast("int").alias("d"), stop.alias("stop"), F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(following, empty, step, lambda acc: acc["out"])


def handler_params(raw: Column) -> Column:
    """Typed parameters as ``name: type``, without self, starred ones and
    dependencies; split at every comma."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.regexp_replace(p, U + r"^\s+|\s+$", "")), lambda p: (p != "") & (p != "self") & ~p.startswith("*"))
    parts = F.filter(parts, lambda p: ~F.contains(p, F.lit("Depends(")) & ~F.contains(p, F.lit("Security(")) & F.contains(p, F.lit(":")))
    return F.transform(parts, lambda p: F.concat(F.trim(F.regexp_extract(p, "^([^:]*):", 1)), F.lit(": "), F.trim(F.regexp_extract(p, "(?s)^[^:]*:([^=]*)", 1))))


def _field(name, kind, required) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), required.alias("required"), F.lit(None).cast("string").alias("description"))


def fastapi_routes(files: DataFrame) -> DataFrame:
    """Decorated handlers; the handler is the first function in the next four
    lines, if any."""
    found = matching_lines(_ends(files, ".py"), [PY_ROUTE], 4)
    handler = F.get(F.filter("next", lambda x: x.rlike(U + PY_DEF)), 0)
    return found.select(
        "project", F.upper(_group("text", PY_ROUTE, 1)).alias("method"), _group("text", PY_ROUTE, 2).alias("path"), "file", "line",
        F.coalesce(_group(handler, PY_DEF, 1), F.lit("")).alias("function_name"), F.coalesce(handler_params(_group(handler, PY_DEF, 2)), _no_strings()).alias("params"), F.lit(None).cast("string").alias("response"),
    )


def fastapi_models(files: DataFrame) -> DataFrame:
    """Pydantic-like classes with the annotated fields of their body."""
    found = matching_lines(_ends(files, ".py"), [PY_MODEL], 50).withColumn("base", _group("text", PY_MODEL, 2))
    body = F.filter(_before_dedent(F.col("next")), lambda x: x.rlike(U + PY_FIELD) & ~_group(x, PY_FIELD, 1).startswith("_"))
    fields = F.transform(body, lambda x: _field(_group(x, PY_FIELD, 1), F.trim(_group(x, PY_FIELD, 2)), ~_group(x, PY_FIELD, 2).rlike("Optional|None")))
    kind = F.when(F.col("base") == "BaseModel", "model").when(F.col("base") == "SQLModel", "entity").otherwise("config")
    return found.select("project", _group("text", PY_MODEL, 1).alias("name"), "file", "line", kind.alias("kind"), F.col("base").alias("base_class"), fields.cast(FIELD_TYPE).alias("fields"), _no_strings().alias("relationships"))


def django_routes(files: DataFrame) -> DataFrame:
    """URL patterns of files that have urls in their path or urlpatterns."""
    some = _ends(files, ".py").where(F.contains("path", F.lit("urls")) | F.contains("content", F.lit("urlpatterns")))
    found = matching_lines(some, [DJANGO_URL]).withColumn("p", _group("text", DJANGO_URL, 1))
    path = F.when(F.col("p") == "", "/").otherwise(F.concat(F.lit("/"), F.regexp_replace("p", "^/+|/+$", "")))
    return found.select("project", F.lit("ALL").alias("method"), path.alias("path"), "file", "line", _group("text", DJANGO_URL, 2).alias("function_name"), _no_strings().alias("params"), F.lit(None).cast("string").alias("response"))


def django_models(files: DataFrame) -> DataFrame:
    """Model classes with the field definitions of their body."""
    some = _ends(files, ".py").where(F.contains("path", F.lit("models")) | F.contains("content", F.lit("models.Model")))
    found = matching_lines(some, [DJANGO_MODEL], 50)
    body = F.filter(_before_dedent(F.col("next")), lambda x: x.rlike(U + DJANGO_FIELD) & ~_group(x, DJANGO_FIELD, 1).startswith("_"))
    fields = F.transform(body, lambda x: _field(_group(x, DJANGO_FIELD, 1), _group(x, DJANGO_FIELD, 2), ~F.contains(x, F.lit("null=True"))))
    return found.select("project", _group("text", DJANGO_MODEL, 1).alias("name"), "file", "line", F.lit("entity").alias("kind"), F.lit("models.Model").alias("base_class"), fields.cast(FIELD_TYPE).alias("fields"), _no_strings().alias("relationships"))


def express_routes(files: DataFrame) -> DataFrame:
    """Every call of a verb with a quoted path, client calls included."""
    found = matching_lines(_ends(files, ".js", ".ts", ".mjs"), [JS_ROUTE])
    return found.select("project", F.upper(_group("text", JS_ROUTE, 1)).alias("method"), _group("text", JS_ROUTE, 2).alias("path"), "file", "line", F.lit("").alias("function_name"), _no_strings().alias("params"), F.lit(None).cast("string").alias("response"))


def express_models(files: DataFrame) -> DataFrame:
    """Interfaces, object types and schemas, the first that a line has."""
    found = matching_lines(_ends(files, ".ts", ".js"), [TS_INTERFACE, TS_TYPE, MONGOOSE], 50)
    kind = F.when(F.col("text").rlike(U + TS_INTERFACE), "interface").when(F.col("text").rlike(U + TS_TYPE), "type").otherwise("schema")
    name = F.when(kind == "interface", _group("text", TS_INTERFACE, 1)).when(kind == "type", _group("text", TS_TYPE, 1)).otherwise(_group("text", MONGOOSE, 1))
    body = F.filter(_within_braces(F.col("next"), 1), lambda x: x.rlike(U + TS_FIELD))
    fields = F.transform(body, lambda x: _field(_group(x, TS_FIELD, 1), F.regexp_replace(_group(x, TS_FIELD, 3), U + r"[;\s]+$", ""), _group(x, TS_FIELD, 2) != "?"))
    out = found.select(
        "project", name.alias("name"), "file", "line", kind.alias("kind"), F.when(kind == "schema", "mongoose.Schema").otherwise("").alias("base_class"),
        F.when(kind == "schema", F.array().cast(FIELD_TYPE)).otherwise(fields.cast(FIELD_TYPE)).alias("fields"), _no_strings().alias("relationships"),
    )
    return out.where("name <> ''")


def _file_route(path: Column, folder: str, endings: str, suffixes: list[str], names: list[tuple[str, str]]) -> Column:
    """A path below a folder as a route."""
    p = F.regexp_replace(path, "^src/", "")
    p = F.regexp_replace(p, f"^.*?{re.escape(folder)}", "")
    p = F.regexp_replace(p, endings, "")
    for s in suffixes:
        p = F.regexp_replace(p, f"/{s}$", "")
    for pattern, to in names:
        p = F.regexp_replace(p, U + pattern, to)
    p = F.when(p == "", "/").otherwise(p)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def react_pages(files: DataFrame) -> DataFrame:
    """Route elements, and files below pages/ or page files below app/."""
    some = _ends(files, ".jsx", ".tsx", ".js", ".ts")
    found = matching_lines(some, [JSX_ROUTE])
    component = F.when(_group("text", JSX_ROUTE, 2) != "", _group("text", JSX_ROUTE, 2)).otherwise(_group("text", JSX_ROUTE, 3))
    inline = found.select("project", _group("text", JSX_ROUTE, 1).alias("path"), F.col("file").alias("component_file"), component.alias("component_name"), "line")
    params = [(r"\[(\w+)\]", ":$1")]
    pages = some.where(F.col("path").rlike("^(?:src/)?pages/"))
    apps = some.where(F.col("path").rlike("^(?:src/)?app/") & F.contains("path", F.lit("/page.")))
    for rows, folder in ((pages, "pages/"), (apps, "app/")):
        route = _file_route(F.col("path"), folder, r"(?:\.(?:tsx|jsx|ts|js))+$", ["index", "page"], params)
        inline = inline.unionByName(rows.select("project", route.alias("path"), F.col("path").alias("component_file"), F.lit("").alias("component_name"), F.lit(0).alias("line")))
    return inline


def vue_pages(files: DataFrame) -> DataFrame:
    """Router entries, and .vue files below pages/."""
    some = _ends(files, ".js", ".ts").where(F.contains(F.lower("path"), F.lit("router")) | F.contains(F.lower("content"), F.lit("routes")))
    found = matching_lines(some, [VUE_ROUTE])
    inline = found.select("project", _group("text", VUE_ROUTE, 1).alias("path"), F.col("file").alias("component_file"), _group("text", VUE_ROUTE, 2).alias("component_name"), "line")
    pages = _ends(files, ".vue").where(F.contains("path", F.lit("pages/")))
    route = _file_route(F.col("path"), "pages/", r"\.vue$", ["index"], [(r"\[(\w+)\]", ":$1"), (r"_(\w+)", ":$1")])
    return inline.unionByName(pages.select("project", route.alias("path"), F.col("path").alias("component_file"), F.lit("").alias("component_name"), F.lit(0).alias("line")))


_PROP = re.compile(r"\s+(\w+)(\??)\s*:\s*(.+?)\s*[;,]?\s*$")


def _props(body: list[str], openers: str, closers: str, first_may_close: int) -> list[str]:
    """Properties of a declaration whose opening line is body[0]."""
    out, depth = [], 0
    for k, line in enumerate(body[:30]):
        depth += sum(line.count(c) for c in openers) - sum(line.count(c) for c in closers)
        m = _PROP.match(line)
        if m:
            out.append(f"{m[1]}: {m[3].rstrip(';,').strip()}{' (optional)' if m[2] else ''}")
        if depth <= 0 and k > first_may_close:
            break
    return out


def _python_table(files: DataFrame, schema: str, of_file: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(project, *row) for project, path, content in zip(pdf["project"], pdf["path"], pdf["content"]) for row in of_file(path, content or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("project", "path", "content").mapInPandas(run, schema)


def react_components(files: DataFrame) -> DataFrame:
    """Function, arrow and class components, in this order within a file, with
    the properties of ``<Name>Props``. Matches may cross lines, which needs
    their offsets, hence Python."""
    patterns = [re.compile(p) for p in REACT_COMPONENTS]

    def of_file(path: str, content: str) -> list[tuple]:
        rows, split = [], content.splitlines()
        for pattern in patterns:
            for m in pattern.finditer(content):
                declared = re.search(rf"(?:interface|type)\s+{m[1]}Props\s*[={{]", content)
                props = _props(split[content[: declared.start()].count("\n") + 1 :], "{", "}", 0) if declared else []
                rows.append((m[1], path, content[: m.start()].count("\n") + 1, props, []))
        return rows

    return _python_table(_ends(files, ".jsx", ".tsx", ".js", ".ts"), COMPONENTS, of_file)


def vue_components(files: DataFrame) -> DataFrame:
    """.vue files with an upper-case name, and the first named component of
    other files."""
    named, typed = re.compile(VUE_COMPONENT), re.compile(VUE_PROPS)

    def of_file(path: str, content: str) -> list[tuple]:
        if path.endswith(".vue"):
            name = path.rsplit("/", 1)[-1][:-4]
            if not name[:1].isupper():
                return []
            m = typed.search(content)
            props = _props(content.splitlines()[content[: m.start()].count("\n") :], "{<", "}>", 1) if m else []
            return [(name, path, 1, props, [])]
        m = named.search(content)
        return [(m[1], path, content[: m.start()].count("\n") + 1, [], [])] if m else []

    return _python_table(_ends(files, ".vue", ".js", ".ts", ".jsx", ".tsx"), COMPONENTS, of_file)


def _reaches(path: Column) -> Column:
    return path.startswith("/") | path.startswith("http")


def react_calls(files: DataFrame) -> DataFrame:
    """Calls of a client, else of fetch; a line that has the first form with
    another path isn't looked at for the second."""
    found = matching_lines(_ends(files, ".jsx", ".tsx", ".js", ".ts"), [REACT_CALL, FETCH_CALL])
    client = F.col("text").rlike(U + REACT_CALL)
    verb = F.upper(_group("text", REACT_CALL, 1))
    posts = F.contains("text", F.lit("method")) & (F.contains("text", F.lit("POST")) | F.contains("text", F.lit("post")))
    method = F.when(client, F.when(verb == "", "GET").otherwise(verb)).otherwise(F.when(posts, "POST").otherwise("GET"))
    path = F.when(client, _group("text", REACT_CALL, 2)).otherwise(_group("text", FETCH_CALL, 1))
    return found.select("project", method.alias("method"), path.alias("path"), "file", "line", F.lit("").alias("function_name")).where(_reaches(F.col("path")))


def vue_calls(files: DataFrame) -> DataFrame:
    """Calls of a client or of the framework's fetch functions."""
    found = matching_lines(_ends(files, ".vue", ".js", ".ts", ".jsx", ".tsx"), [VUE_CALL])
    verb = F.upper(_group("text", VUE_CALL, 1))
    return found.select("project", F.when(verb == "", "GET").otherwise(verb).alias("method"), _group("text", VUE_CALL, 2).alias("path"), "file", "line", F.lit("").alias("function_name")).where(_reaches(F.col("path")))


def _stores(files: DataFrame, first: str, first_kind: str, second: str, second_kind: str, second_name: Column | None) -> DataFrame:
    found = matching_lines(files, [first, second])
    is_first = F.col("text").rlike(U + first)
    name = F.when(is_first, _group("text", first, 1)).otherwise(second_name if second_name is not None else _group("text", second, 1))
    return found.select("project", name.alias("name"), "file", "line", F.when(is_first, first_kind).otherwise(second_kind).alias("kind"), _no_strings().alias("state_fields"), _no_strings().alias("actions"))


def react_stores(files: DataFrame) -> DataFrame:
    """Stores of the two common libraries."""
    return _stores(_ends(files, ".js", ".ts", ".jsx", ".tsx"), ZUSTAND, "zustand", REDUX, "redux", None)


def vue_stores(files: DataFrame) -> DataFrame:
    """Stores of the two common libraries; the older kind is named root."""
    return _stores(_ends(files, ".js", ".ts"), PINIA, "pinia", VUEX, "vuex", F.lit("root"))


@dataclass
class Extractor:
    """A framework: what it is, how it is recognised, and its tables."""

    name: str
    language: str
    project_type: str
    markers: list[tuple[str, str]]
    tables: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


REGISTRY: dict[str, Extractor] = {}
SCHEMAS = {"routes": ROUTES, "models": MODELS, "pages": PAGES, "components": COMPONENTS, "stores": STORES, "api_calls": CALLS}


def register(extractor: Extractor) -> Extractor:
    """Adds an extractor; a later one replaces one of the same name in its
    place."""
    REGISTRY[extractor.name] = extractor
    return extractor


def get_extractor(name: str) -> Extractor | None:
    return REGISTRY.get(name)


def list_extractors() -> list[str]:
    return list(REGISTRY)


register(Extractor("fastapi", "python", "backend", [("pyproject.toml", "fastapi"), ("requirements.txt", "fastapi"), ("setup.py", "fastapi")], {"routes": fastapi_routes, "models": fastapi_models}))
register(Extractor("django", "python", "backend", [("pyproject.toml", "django"), ("requirements.txt", "django"), ("manage.py", "django")], {"routes": django_routes, "models": django_models}))
register(Extractor("express", "javascript", "backend", [("package.json", "express")], {"routes": express_routes, "models": express_models}))
register(Extractor("react", "javascript", "frontend", [("package.json", "react")], {"pages": react_pages, "components": react_components, "api_calls": react_calls, "stores": react_stores}))
register(Extractor("vue", "javascript", "frontend", [("package.json", "vue")], {"pages": vue_pages, "components": vue_components, "api_calls": vue_calls, "stores": vue_stores}))
