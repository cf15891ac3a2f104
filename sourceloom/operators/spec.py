"""Queries on specifications, which are read by lines, not as YAML.

``specs`` has one row per specification: spec_id (the file's stem), file and
content; ``projects`` has name and type (backend or frontend). A specification
is text of bounded size; its lines are folded within its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.functions.text import lines
from sourceloom.session import durable

#: Sections that always count, and keys that are no sections.
RESERVED_SECTIONS = {"backend": "backend", "frontend": "frontend"}
PLAIN_KEYS = ("id", "title", "status", "description", "testing", "test", "affected_files", "notes")
FILE_KEYS = ("id", "title", "status", "description", "testing", "test", "notes")
BACKEND_LANGUAGES = ("python", "go", "java", "rust")
FRONTEND_FRAMEWORKS = ("react", "vue", "angular", "next", "nuxt", "svelte")

_STRIP = r"(?U)^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def _outer(line: Column) -> Column:
    """Whether a line isn't indented."""
    return ~line.startswith(" ") & ~line.startswith("\t")


def _after_colon(line: Column) -> Column:
    return _strip(F.regexp_replace(line, "(?s)^[^:]*:", ""))


def header_field(content: Column, key: str) -> Column:
    """The last value of a key at the margin in the first 20 lines, quotes
    stripped; empty if there is none."""
    hits = F.filter(F.slice(lines(content), 1, 20), lambda x: x.startswith(f"{key}:"))
    value = _strip(F.substring(F.try_element_at(hits, F.lit(-1)), len(key) + 2, 1 << 30))
    return F.coalesce(F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", ""), F.lit(""))


def list_specs(specs: DataFrame) -> DataFrame:
    """(spec_id, id, title, status, description, file); the id is the file's
    stem unless given."""
    stated = header_field(F.col("content"), "id")
    has_id = F.exists(F.slice(lines(F.col("content")), 1, 20), lambda x: x.startswith("id:"))
    return specs.select("spec_id", F.when(has_id, stated).otherwise(F.col("spec_id")).alias("id"), *[header_field(F.col("content"), k).alias(k) for k in ("title", "status", "description")], "file")


def show_spec(specs: DataFrame, wanted: str) -> DataFrame:
    """The specification of that stem or file name, else the first whose stem
    contains it, by file name."""
    exact = (F.col("spec_id") == wanted) | F.regexp_extract("file", "([^/]+)$", 1).eqNullSafe(F.lit(wanted))
    rank = F.when(exact, 0).when(F.contains("spec_id", F.lit(wanted)), 1)
    return specs.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", "file").limit(1).drop("__rank")


def with_status(content: Column, status: str) -> Column:
    """The text with the first status line at the margin replaced; null if it
    has none."""
    ls = lines(content)
    at = F.array_position(F.transform(ls, lambda x: x.startswith("status:")), True)
    changed = F.transform(ls, lambda x, i: F.when(i + 1 == at, F.lit(f"status: {status}")).otherwise(x))
    return F.when(at > 0, F.concat(F.array_join(changed, "\n"), F.lit("\n")))


def is_active(content: Column) -> Column:
    """Whether the first status line of the first 15 says approved or
    in_progress."""
    first = F.get(F.filter(F.slice(lines(content), 1, 15), lambda x: x.startswith("status:")), 0)
    return F.coalesce(_after_colon(first).isin("approved", "in_progress"), F.lit(False))


def workspace_projects(spark: SparkSession, text: str) -> DataFrame:
    """(name, type) of the projects that a workspace file lists, by language,
    overruled by a frontend framework."""
    found: dict[str, str] = {}
    name = ""
    for line in map(str.strip, text.splitlines()):
        key, _, value = line.partition(":")
        value = value.strip()
        if key == "- name":
            name = value
        elif key == "language" and name:
            found[name] = "backend" if value in BACKEND_LANGUAGES else "frontend"
        elif key == "framework" and name and any(f in value.lower() for f in FRONTEND_FRAMEWORKS):
            found[name] = "frontend"
    return spark.createDataFrame(list(found.items()), "name string, type string")


def sections(specs: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(spec_id, section, type, ord): keys at the margin that are reserved or
    name a project."""
    split = specs.select("spec_id", F.posexplode(lines(F.col("content"))).alias("ln", "line"))
    keys = split.where(_outer(F.col("line")) & F.contains("line", F.lit(":"))).select("spec_id", "ln", _strip(F.substring_index("line", ":", 1)).alias("section")).where(~F.col("section").isin(*PLAIN_KEYS))
    spark = specs.sparkSession
    known = spark.createDataFrame(list(RESERVED_SECTIONS.items()), "section string, type string")
    if projects is not None:
        known = known.unionByName(projects.where(~F.col("name").isin(*RESERVED_SECTIONS)).select(F.col("name").alias("section"), "type"))
    return keys.join(F.broadcast(known), "section").groupBy("spec_id", "section", "type").agg(F.min("ln").alias("ord"))


_API = "array<struct<method:string,path:string,has_body:boolean>>"


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _stripped_lines(content: Column, *more) -> Column:
    """Lines as structs of ``raw``, ``s`` (stripped), ``heads`` (a testing
    key) and what more gives from raw and s."""

    def parts(raw):
        s = _strip(raw)
        return _let(s, lambda s: F.struct(raw.alias("raw"), s.alias("s"), (s.startswith("testing:") | s.startswith("test:")).alias("heads"), *[f(raw, s) for f in more]))

    return F.transform(lines(content), parts)


def _opens(raw, s) -> Column:
    """Whether a line opens the row's section."""
    return (s == F.concat(F.col("section"), F.lit(":"))).alias("opens")


def _leaves(raw, s) -> Column:
    """Whether a line at the margin ends any section."""
    return (~raw.startswith(" ") & (s != "") & F.contains(s, F.lit(":"))).alias("leaves")


def spec_apis(specs: DataFrame, section_table: DataFrame) -> DataFrame:
    """(spec_id, section, type, api_ord, method, path, has_body): blocks with a
    method and a path, which end at a blank line, at the next ``- id:`` or with
    the section's text, and bullets that begin with a verb and a path."""
    bullet = r"(?U)^\s*-\s*(GET|POST|PUT|DELETE|PATCH)\s+(/\S+)"
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("inside"), none.alias("method"), none.alias("path"), F.lit(False).alias("body"), F.array().cast(_API).alias("out"))
    more = (
        _opens, _leaves,
        lambda raw, s: F.when(F.contains(s, F.lit("method:")), _after_colon(s)).alias("method"),
        lambda raw, s: F.when(F.contains(s, F.lit("path:")), F.regexp_replace(_after_colon(s), "^['\"]+|['\"]+$", "")).alias("path"),
        lambda raw, s: (F.contains(s, F.lit("body:")) | F.contains(s, F.lit("request:"))).alias("body"),
        lambda raw, s: F.when(s.rlike(bullet), _api(F.regexp_extract(s, bullet, 1), F.regexp_extract(s, bullet, 2), F.lit(False))).alias("bullet"),
        lambda raw, s: ((s == "") | s.startswith("- id:")).alias("ends"),
    )

    def is_whole(v):
        return F.coalesce((v["method"] != "") & (v["path"] != ""), F.lit(False))

    def read(acc, x):
        """What is open once a line inside the section is read."""
        out = F.when(x["bullet"].isNotNull(), F.concat(acc["out"], F.array(x["bullet"]))).otherwise(acc["out"])
        return F.struct(F.coalesce(x["method"], acc["method"]).alias("method"), F.coalesce(x["path"], acc["path"]).alias("path"), (acc["body"] | x["body"]).alias("body"), out.alias("out"))

    def close(v, x):
        """What is open after it."""
        shut = F.struct(F.lit(True).alias("inside"), none.alias("method"), none.alias("path"), F.lit(False).alias("body"), F.concat(v["out"], F.array(_api(v["method"], v["path"], v["body"]))).alias("out"))
        return F.when(x["ends"] & is_whole(v), shut).otherwise(F.struct(F.lit(True).alias("inside"), v["method"].alias("method"), v["path"].alias("path"), v["body"].alias("body"), v["out"].alias("out")))

    def step(acc, x):
        inside = ~x["opens"] & acc["inside"] & ~x["leaves"]
        outside = F.struct(x["opens"].alias("inside"), acc["method"].alias("method"), acc["path"].alias("path"), acc["body"].alias("body"), acc["out"].alias("out"))
        return F.when(inside, _let(read(acc, x), lambda v: close(v, x))).otherwise(outside)

    def finish(acc):
        return F.when(is_whole(acc), F.concat(acc["out"], F.array(_api(acc["method"], acc["path"], acc["body"])))).otherwise(acc["out"])

    joined = section_table.select("spec_id", "section", "type").join(specs.select("spec_id", "content"), "spec_id")
    found = joined.withColumn("apis", F.aggregate(_stripped_lines(F.col("content"), *more), start, step, finish))
    return found.select("spec_id", "section", "type", F.posexplode("apis").alias("api_ord", "a")).select("spec_id", "section", "type", "api_ord", "a.*")


def _api(method, path, body) -> Column:
    return F.struct(method.alias("method"), path.alias("path"), body.alias("has_body"))


def test_cases(specs: DataFrame, section_table: DataFrame) -> DataFrame:
    """(spec_id, section, type, case_ord, case): bullets below a section's
    testing key."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("testing"), F.array().cast("array<string>").alias("out"))
    case = lambda raw, s: F.when(s.startswith("- "), _strip(F.substring(s, 3, 1 << 30))).alias("case")

    def step(acc, x):
        inside = ~x["opens"] & acc["inside"] & ~x["leaves"]
        testing = F.when(x["opens"], acc["testing"]).otherwise(inside & (acc["testing"] | x["heads"]))
        takes = inside & ~x["heads"] & acc["testing"] & x["case"].isNotNull()
        return F.struct((x["opens"] | inside).alias("inside"), testing.alias("testing"), F.when(takes, F.concat(acc["out"], F.array(x["case"]))).otherwise(acc["out"]).alias("out"))

    joined = section_table.select("spec_id", "section", "type").join(specs.select("spec_id", "content"), "spec_id")
    found = joined.withColumn("cases", F.aggregate(_stripped_lines(F.col("content"), _opens, _leaves, case), start, step, lambda acc: acc["out"]))
    return found.select("spec_id", "section", "type", F.posexplode("cases").alias("case_ord", "case"))


def affected_files(specs: DataFrame) -> DataFrame:
    """(spec_id, ord, path, section, comment): bullets with a slash below any
    section at the margin."""
    entry = "array<struct<path:string,section:string,comment:string>>"
    start = F.struct(F.lit("").alias("section"), F.array().cast(entry).alias("out"))

    def step(acc, x):
        s, raw = x["s"], x["raw"]
        key = F.regexp_replace(s, ":+$", "")
        section = F.when(_outer(raw) & s.endswith(":") & ~key.isin(*FILE_KEYS), key).otherwise(acc["section"])
        takes = ~F.contains(s, F.lit("affected_files:")) & (section != "") & s.startswith("- ") & F.contains(s, F.lit("/"))
        path = _strip(F.substring_index(F.regexp_replace(s, "^[- ]+", ""), "#", 1))
        comment = F.when(F.contains(s, F.lit("#")), _strip(F.get(F.split(s, "#"), 1))).otherwise("")
        return F.struct(section.alias("section"), F.when(takes, F.concat(acc["out"], F.array(F.struct(path.alias("path"), section.alias("section"), comment.alias("comment"))))).otherwise(acc["out"]).alias("out"))

    found = specs.select("spec_id", F.posexplode(F.aggregate(_stripped_lines(F.col("content")), start, step, lambda acc: acc["out"])).alias("ord", "e"))
    return found.select("spec_id", "ord", "e.*")


def validate_specs(specs: DataFrame, projects: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(spec_id, part, ord, level, message, location) of what a specification
    lacks: required keys, request bodies, routes for frontend calls (path
    parameters of any name alike), files to be modified, test cases.

    files has project and path; a file may be given with or without its
    project. The word for "modify" in a comment is a fixed value.
    """
    ids = specs.select("spec_id").distinct()
    split = specs.select("spec_id", F.explode(lines(F.col("content"))).alias("line"))
    keys = split.where(_outer(F.col("line")) & F.contains("line", F.lit(":"))).select("spec_id", _strip(F.substring_index("line", ":", 1)).alias("key")).distinct()
    needed = ids.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("ord")) for n, k in enumerate(("id", "title", "status"))]))).select("spec_id", "r.*")
    missing = needed.join(keys, ["spec_id", "key"], "left_anti")
    out = missing.select("spec_id", F.lit(1).alias("part"), "ord", F.lit("error").alias("level"), F.concat(F.lit("Missing required field: "), F.col("key")).alias("message"), F.lit("top-level").alias("location"))
    table = sections(specs, projects)
    apis = durable(spec_apis(specs, table))
    bare = apis.where((F.col("type") == "backend") & F.col("method").isin("POST", "PUT", "PATCH") & ~F.col("has_body"))
    out = out.unionByName(bare.select("spec_id", F.lit(2).alias("part"), F.col("api_ord").alias("ord"), F.lit("warning").alias("level"), F.concat("method", F.lit(" "), "path", F.lit(" has no request body fields defined")).alias("message"), F.concat("section", F.lit(".api")).alias("location")))
    alike = F.regexp_replace("path", r"\{[^}]+\}", "{}")
    calls = apis.where((F.col("type") == "frontend") & (F.col("path") != "") & ~F.col("path").startswith("http")).select("spec_id", "section", "path", alike.alias("alike")).distinct()
    served = apis.where((F.col("type") == "backend") & (F.col("path") != "")).select("spec_id", alike.alias("alike")).distinct()
    lost = calls.join(served, ["spec_id", "alike"], "left_anti")
    out = out.unionByName(lost.select("spec_id", F.lit(3).alias("part"), F.lit(0).alias("ord"), F.lit("error").alias("level"), F.concat(F.lit("["), "section", F.lit("] calls "), "path", F.lit(" but no backend has a matching route")).alias("message"), F.concat("section", F.lit("-backend alignment")).alias("location")))
    if files is not None:
        known = files.select("path").unionByName(files.select(F.concat_ws("/", "project", "path").alias("path"))).distinct()
        where = F.concat("section", F.lit(": "), "comment")
        gone = affected_files(specs).where(F.contains(where, F.lit("修改"))).join(known, "path", "left_anti")
        out = out.unionByName(gone.select("spec_id", F.lit(4).alias("part"), "ord", F.lit("warning").alias("level"), F.concat(F.lit("File to modify not found: "), "path").alias("message"), where.alias("location")))
    has = F.contains("content", F.lit("testing:")) | F.contains("content", F.lit("test:"))
    tested = specs.select("spec_id", has.alias("has"), _n_test_lines(F.col("content")).alias("n"))
    text = F.when(~F.col("has"), "No testing section found in spec").when(F.col("n") == 0, "Testing section exists but has no test cases")
    return out.unionByName(tested.select("spec_id", F.lit(5).alias("part"), F.lit(0).alias("ord"), F.lit("warning").alias("level"), text.alias("message"), F.lit("testing").alias("location")).where("message IS NOT NULL"))


def _n_test_lines(content: Column) -> Column:
    """Bullets below testing keys, up to the next text at the margin."""
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"))

    def step(acc, x):
        takes = ~x["heads"] & acc["on"] & x["s"].startswith("- ")
        ends = acc["on"] & ~takes & (x["s"] != "") & ~x["s"].startswith("#") & ~x["raw"].startswith(" ")
        return F.struct((x["heads"] | acc["on"] & ~ends).alias("on"), (acc["n"] + takes.cast("int")).alias("n"))

    return F.aggregate(_stripped_lines(content), start, step, lambda acc: acc["n"])


def validation_summary(specs: DataFrame, issues: DataFrame) -> DataFrame:
    """(spec_id, passed, n_errors, n_warnings); a specification passes without
    errors."""
    counted = issues.groupBy("spec_id").agg(F.count(F.when(F.col("level") == "error", 1)).alias("e"), F.count(F.when(F.col("level") == "warning", 1)).alias("w"))
    joined = specs.select("spec_id").distinct().join(counted, "spec_id", "left")
    return joined.select("spec_id", (F.coalesce("e", F.lit(0)) == 0).alias("passed"), F.coalesce("e", F.lit(0)).alias("n_errors"), F.coalesce("w", F.lit(0)).alias("n_warnings"))


def validation_report(specs: DataFrame, issues: DataFrame) -> DataFrame:
    """(spec_id, report): the issues as text."""
    place = F.when(F.col("location") != "", F.concat(F.lit(" ["), "location", F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  ["), F.when(F.col("level") == "error", "ERROR").otherwise("WARN"), F.lit("]"), place, F.lit(" "), "message")
    text = issues.groupBy("spec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "location", "ord", line.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    both = validation_summary(specs, issues).join(text, "spec_id", "left")
    head = F.concat(F.lit("Spec "), "spec_id", F.lit(": "), "n_errors", F.lit(" error(s), "), "n_warnings", F.lit(" warning(s)\n"))
    return both.select("spec_id", F.when(F.col("body").isNull(), F.concat(F.lit("Spec "), "spec_id", F.lit(": OK (no issues)"))).otherwise(F.concat_ws("\n", head, "body")).alias("report"))


def _function_name(case: Column) -> Column:
    name = F.lower(F.regexp_replace(case, "[^a-zA-Z0-9_]", "_"))
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_+|_+$", "")
    return F.when(F.length(name) > 60, F.regexp_replace(F.substring(name, 1, 60), "_+$", "")).otherwise(name)


def test_skeletons(specs: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(spec_id, filename, code): a file of empty tests per section that has
    test cases, pytest for backends and Jest for the others. A test names the
    first call whose method or path its case contains. Specifications without
    any known section have none, as the reserved ones are known."""
    table = sections(specs, projects)
    cases = test_cases(specs, table)
    apis = spec_apis(specs, table).groupBy("spec_id", "section").agg(F.array_sort(F.collect_list(F.struct("api_ord", "method", "path"))).alias("apis"))
    titled = specs.select("spec_id", header_field(F.col("content"), "title").alias("title"))
    rows = cases.join(apis, ["spec_id", "section"], "left").join(titled, "spec_id")
    low = F.lower("case")
    hit = F.get(F.filter("apis", lambda a: F.contains(low, F.lower(a["method"])) | F.contains(low, F.lower(a["path"]))), 0)
    note = F.when(hit.isNotNull() & (F.col("type") == "backend"), F.concat(F.lit("    # API: "), hit["method"], F.lit(" "), hit["path"]))
    python = F.concat_ws("\n", F.concat(F.lit("def test_"), _function_name(F.col("case")), F.lit("():")), F.lit('    """'), F.concat(F.lit("    "), "case"), F.lit('    """'), note, F.lit("    # TODO: implement"), F.lit("    raise NotImplementedError"), F.lit(""), F.lit(""))
    script = F.concat_ws("\n", F.concat(F.lit('  it("'), F.replace(F.col("case"), F.lit('"'), F.lit('\\"')), F.lit('", () => {')), F.lit("    // TODO: implement"), F.lit("    throw new Error('Not implemented');"), F.lit("  });"), F.lit(""))
    rows = rows.withColumn("block", F.when(F.col("type") == "backend", python).otherwise(script))
    grouped = rows.groupBy("spec_id", "section", "type", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_ord", "block"))), lambda s: s["block"]), "\n").alias("body"))
    safe = F.lower(F.regexp_replace("spec_id", "[^a-zA-Z0-9_]", "_"))
    head_py = F.concat(F.lit('"""Tests for: '), "title", F.lit('\n\nGenerated from a specification; the tests have to be written.\n"""\n\nimport pytest\n\n\n'))
    head_js = F.concat(F.lit("/**\n * Tests for: "), "title", F.lit("\n *\n * Generated from a specification; the tests have to be written.\n */\n\ndescribe(\""), "title", F.lit('", () => {\n'))
    back = F.col("type") == "backend"
    return grouped.select(
        "spec_id", F.concat(F.lit("test_"), safe, F.lit("_"), "section", F.when(back, ".py").otherwise(".ts")).alias("filename"),
        F.when(back, F.concat(head_py, "body")).otherwise(F.concat(head_js, "body", F.lit("\n});\n"))).alias("code"),
    )
