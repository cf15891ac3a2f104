"""Text views of scans and analyses.

Views come in pieces, a row per file, module or object, whatever the size of a
project. The functions that give one row of text per project are for a single
reader, as on the command line; queries over many projects use the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.functions.text import walk_key


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str, out: str) -> DataFrame:
    """The texts of each key, in order, joined by line ends."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda s: s["__t"]), "\n").alias(out))


def file_details(files: DataFrame, symbols: DataFrame, imports: DataFrame, mark: str = "##", max_depth: int = 2) -> DataFrame:
    """(project, path, detail): a file's heading, imports and symbols."""
    keys = ["project", "path"]
    named = F.when(F.size("names") > 0, F.concat(F.lit("  import "), F.col("module"), F.lit(" :: "), F.array_join("names", ", "))).otherwise(F.concat(F.lit("  import "), F.col("module")))
    lines = imports.select(*keys, F.lit(0).alias("part"), "ord", named.alias("t"))
    shown = symbols if max_depth > 1 else symbols.where("parent_ord IS NULL")
    indent = F.when(F.col("parent_ord").isNull(), "  ").otherwise("    ")
    lines = lines.unionByName(shown.select(*keys, F.lit(1).alias("part"), "ord", F.concat(indent, F.coalesce("signature", "name"), F.lit("  [L"), F.col("line"), F.lit("]")).alias("t")))
    body = _joined(lines, keys, ["part", "ord"], "t", "body")
    head = F.concat(F.lit(f"{mark} "), F.col("path"), F.lit("  ("), F.col("language"), F.lit(", "), F.col("lines"), F.lit(" lines)"))
    return files.join(body, keys, "left").select(*keys, F.concat_ws("\n", head, "body", F.lit("")).alias("detail"))


def full_map(files: DataFrame, symbols: DataFrame, imports: DataFrame, max_depth: int = 2) -> DataFrame:
    """(project, text): every file with its imports and symbols."""
    detail = file_details(files, symbols, imports, "##", max_depth).withColumn("w", walk_key(F.col("path")))
    body = _joined(detail, ["project"], ["w"], "detail", "body")
    return body.select("project", F.concat_ws("\n", F.concat(F.lit("# Repo Map: "), F.col("project")), F.lit(""), "body").alias("text"))


def focused_map(files: DataFrame, symbols: DataFrame, imports: DataFrame, focus: DataFrame, max_depth: int = 2, show_others: bool = True) -> DataFrame:
    """(project, text): the files of focus (project, path) in detail, the others
    as one line each."""
    pieces = focused_pieces(files, symbols, imports, focus, max_depth, show_others).withColumn("w", walk_key(F.col("path")))
    titles = {1: "## Relevant files (detailed)", 2: "## Other files (summary)"}
    section = _joined(pieces, ["project", "part"], ["w"], "t", "body")
    title = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])[F.col("part")]
    shown = section.withColumn("t", F.concat_ws("\n", title, F.lit(""), "body", F.when(F.col("part") == 2, "")))
    body = _joined(shown, ["project"], ["part"], "t", "body")
    return body.select("project", F.concat_ws("\n", F.concat(F.lit("# Repo Map: "), F.col("project")), F.lit(""), "body").alias("text"))


def focused_pieces(files: DataFrame, symbols: DataFrame, imports: DataFrame, focus: DataFrame, max_depth: int = 2, show_others: bool = True) -> DataFrame:
    """(project, part, path, t): the files of focus in detail (part 1) and the
    others as a line each (part 2)."""
    keys = ["project", "path"]
    chosen = files.join(focus.select(*keys).distinct(), keys, "left_semi")
    detail = file_details(chosen, symbols.join(chosen.select(*keys), keys, "left_semi"), imports.join(chosen.select(*keys), keys, "left_semi"), "###", max_depth)
    out = detail.select("project", F.lit(1).alias("part"), "path", F.col("detail").alias("t"))
    if not show_others:
        return out
    rest = file_summaries(files, symbols).join(chosen.select(*keys), keys, "left_anti")
    line = F.concat(F.lit("  "), F.col("path"), F.lit("  ("), F.col("lines"), F.lit(" lines, "), F.col("n_symbols"), F.lit(" symbols)"))
    return out.unionByName(rest.select("project", F.lit(2).alias("part"), "path", line.alias("t")))


def file_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, path, language, lines, n_symbols), symbols at top level."""
    counted = symbols.where("parent_ord IS NULL").groupBy("project", "path").agg(F.count(F.lit(1)).alias("n_symbols"))
    return files.join(counted, ["project", "path"], "left").select("project", "path", "language", "lines", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def file_json(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, path, json): the scan of a file as a nested record."""
    keys = ["project", "path"]
    leaf = F.struct("ord", "name", "kind", "line", "signature")
    children = symbols.where("parent_ord IS NOT NULL").groupBy(*keys, F.col("parent_ord").alias("ord")).agg(F.array_sort(F.collect_list(leaf)).alias("children"))
    top = symbols.where("parent_ord IS NULL").join(children, [*keys, "ord"], "left")
    nested = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "line", "signature", "children"))).alias("symbols"))
    imported = imports.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "module", "names", "line"))).alias("imports"))
    rows = files.join(nested, keys, "left").join(imported, keys, "left")
    return rows.select(*keys, F.to_json(F.struct("path", "language", "lines", "symbols", "imports")).alias("json"))


def map_json(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, json): the scan as nested records."""
    rows = file_json(files, symbols, imports).withColumn("w", walk_key(F.col("path")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "json"))), lambda s: s["json"]), ",")
    return rows.groupBy("project").agg(F.concat(F.lit('{"root":'), F.regexp_extract(F.to_json(F.struct(F.first("project").alias("p"))), '(?s)^."p":(.*).$', 1), F.lit(',"files":['), listed, F.lit("]}")).alias("json"))


def scan_totals(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, n_files, n_symbols, n_imports), children included."""
    out = files.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    for rows, name in ((symbols, "n_symbols"), (imports, "n_imports")):
        out = out.join(rows.groupBy("project").agg(F.count(F.lit(1)).alias(name)), "project", "left").fillna(0, [name])
    return out


def module_of(path: Column) -> Column:
    """The first directory of a path, or (root)."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def module_rollup(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, module, n_files, n_symbols, n_lines)."""
    rows = file_summaries(files, symbols).withColumn("module", module_of(F.col("path")))
    return rows.groupBy("project", "module").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.sum("lines").alias("n_lines"))


def module_key_files(files: DataFrame, symbols: DataFrame, top: int = 5, names: int = 3) -> DataFrame:
    """(project, module, rank, path, n_symbols, names): the files of a module
    with most top-level symbols, ties in walk order, those without left out."""
    keys = ["project", "path"]
    counted = symbols.where("parent_ord IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_symbols"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), 1, names).alias("names"))
    rows = files.select(*keys).join(counted, keys).withColumn("module", module_of(F.col("path")))
    w = Window.partitionBy("project", "module").orderBy(F.desc("n_symbols"), walk_key(F.col("path")))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("project", "module", "rank", "path", "n_symbols", "names")


def module_texts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, module, t): a module's counts and its key files."""
    head = module_rollup(files, symbols).select("project", "module", F.lit(0).alias("rank"), F.concat(F.lit("## "), F.col("module"), F.lit("/\n  files: "), F.col("n_files"), F.lit(", symbols: "), F.col("n_symbols"), F.lit(", lines: "), F.col("n_lines")).alias("t"))
    rows = head.unionByName(module_key_files(files, symbols).select("project", "module", "rank", F.concat(F.lit("  "), F.col("path"), F.lit(": "), F.array_join("names", ", ")).alias("t")))
    return _joined(rows, ["project", "module"], ["rank"], "t", "t")


def modules_text(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, text) of the module structure."""
    body = _joined(module_texts(files, symbols).withColumn("t", F.concat("t", F.lit("\n"))), ["project"], ["module"], "t", "body")
    return body.select("project", F.concat_ws("\n", F.lit("# Module Structure"), F.lit(""), "body").alias("text"))


def _text_or_none(value: Column, *parts) -> Column:
    """The joined parts where a value is neither null nor empty."""
    return F.when(value.isNotNull() & (value != ""), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _listed(values: Column, title: str) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"  {title}:\n    "), F.array_join(values, "\n    ")))


#: How each object table is shown: heading, blocks of an object, whether a
#: blank line follows each.
def _blocks(name: str) -> tuple[str, list[Column], bool]:
    c = F.col
    at = F.concat(F.lit("  file: "), c("file"), F.lit("  L"), c("line")) if name in ("routes", "models", "components", "stores", "api_calls") else None
    if name == "routes":
        return "# API Routes", [F.concat(F.lit("## "), c("method"), F.lit(" "), c("path")), at, _text_or_none(c("function_name"), "  handler: ", c("function_name")), _listed(c("params"), "params"), _text_or_none(c("response"), "  response: ", c("response"))], True
    if name == "models":
        base = F.when(F.coalesce("base_class", F.lit("")) != "", F.concat(F.lit("## "), c("name"), F.lit(" ("), c("base_class"), F.lit(")"))).otherwise(F.concat(F.lit("## "), c("name")))
        fields = F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["type"], F.when(f["required"], "").otherwise(" (optional)")))
        return "# Data Models", [base, at, F.concat(F.lit("  kind: "), c("kind")), _listed(fields, "fields"), _listed(c("relationships"), "relationships")], True
    if name == "pages":
        return "# Page Routes", [F.concat(F.lit("## "), c("path")), F.concat(F.lit("  component: "), c("component_file")), _text_or_none(c("component_name"), "  name: ", c("component_name"))], True
    if name == "components":
        return "# Components", [F.concat(F.lit("## "), c("name")), at, _listed(c("props"), "props"), F.when(F.size("used_in") > 0, F.concat(F.lit("  used_in: "), F.array_join("used_in", ", ")))], True
    if name == "stores":
        return "# State Stores", [F.concat(F.lit("## "), c("name"), F.lit(" ("), c("kind"), F.lit(")")), at, _listed(c("state_fields"), "state"), _listed(c("actions"), "actions")], True
    if name == "api_calls":
        return "# API Calls (to backend)", [F.concat(F.lit("## "), c("method"), F.lit(" "), c("path")), at, _text_or_none(c("function_name"), "  function: ", c("function_name"))], True
    if name == "infra":
        return "# Infrastructure", [F.concat(F.lit("## "), c("name"), F.lit(" ("), c("kind"), F.lit(")")), F.concat(F.lit("  source: "), c("source")), _text_or_none(c("details"), "  details: ", c("details"))], True
    if name == "env_vars":
        head = F.concat(F.lit("  "), c("name"), F.when(F.coalesce("default_value", F.lit("")) != "", F.concat(F.lit(" = "), c("default_value"))).otherwise(""))
        return "# Environment Variables", [head, _text_or_none(c("description"), "    # ", c("description")), _text_or_none(c("source"), "    source: ", c("source"))], False
    raise ValueError(name)


def object_texts(rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``t``, the text of each object of a table."""
    _, blocks, gap = _blocks(name)
    return rows.select(*keep, F.concat_ws("\n", *blocks, *([F.lit("")] if gap else [])).alias("t"))


def render_objects(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(project, text) of an object table; projects without objects have no
    row. order names the columns that order the objects."""
    title, _, gap = _blocks(name)
    body = _joined(object_texts(rows, name, ["project", *order]), ["project"], order, "t", "body")
    tail = [] if gap else [F.lit("")]
    return body.select("project", F.concat_ws("\n", F.lit(title), F.lit(""), "body", *tail).alias("text"))


def dependency_lines(files: DataFrame) -> DataFrame:
    """(project, part, ord, text): what the dependency files at a project's root
    list. Python lines with a version comparison are skipped, and count only
    with an equals sign and a quote; npm entries are sorted; module files give
    their lines."""
    strip = r"(?U)^\s+|\s+$"
    python = files.where(F.col("path").isin("pyproject.toml", "requirements.txt")).groupBy("project").agg(F.min_by(F.struct("path", "content"), F.col("path") != "pyproject.toml").alias("f"))
    rows = python.select("project", F.col("f.path").alias("source"), F.posexplode(F.split("f.content", "\r?\n")).alias("ord", "raw")).withColumn("x", F.regexp_replace("raw", strip, ""))
    keep = (F.col("x") != "") & ~F.col("x").rlike(r"^[#\[-]") & ~F.col("x").rlike(">=|==") & F.contains("x", F.lit("=")) & F.contains("x", F.lit('"'))
    out = rows.where(keep).select("project", "source", F.lit(0).alias("part"), "ord", F.regexp_replace("x", '^[",]+|[",]+$', "").alias("text"))
    package = files.where(F.col("path") == "package.json")
    for k, section in enumerate(("dependencies", "devDependencies")):
        deps = F.from_json(F.get_json_object("content", f"$.{section}"), "map<string,string>")
        entries = package.select("project", F.posexplode(F.array_sort(F.map_entries(deps))).alias("ord", "e"))
        out = out.unionByName(entries.select("project", F.lit(section).alias("source"), F.lit(1 + k).alias("part"), "ord", F.concat("e.key", F.lit(": "), "e.value").alias("text")))
    module = files.where(F.col("path") == "go.mod").select("project", F.posexplode(F.split("content", "\r?\n")).alias("ord", "raw")).withColumn("x", F.regexp_replace("raw", strip, ""))
    keep = (F.col("x") != "") & ~F.col("x").startswith("//") & ~F.col("x").startswith("module") & ~F.col("x").isin("require (", ")")
    return out.unionByName(module.where(keep).select("project", F.lit("go.mod").alias("source"), F.lit(3).alias("part"), "ord", F.col("x").alias("text")))


def dependencies_text(files: DataFrame) -> DataFrame:
    """(project, text) of the dependency lines under their sources."""
    rows = dependency_lines(files)
    section = _joined(rows.withColumn("t", F.concat(F.lit("  "), F.col("text"))), ["project", "part", "source"], ["ord"], "t", "body")
    section = section.withColumn("t", F.concat_ws("\n", F.concat(F.lit("## "), F.col("source")), "body", F.lit("")))
    return _joined(section, ["project"], ["part"], "t", "body").select("project", F.concat_ws("\n", F.lit("# Dependencies"), F.lit(""), "body").alias("text"))
