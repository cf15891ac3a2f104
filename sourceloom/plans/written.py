"""Queries over texts that are written from tables.

No table holds specifications, or sources of every framework. So objects of the
tables (routes, calls, symbols) are written down as specifications and in the
notations of the frameworks, one text per file and 500 lines of it, and found
again by the operators. The SQL twins take the objects from the tables
themselves and never see the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.extract import frameworks as fw
from sourceloom.operators import spec
from sourceloom.operators.mapviews import object_texts
from sourceloom.session import durable, spread, table

#: Lines of a source file whose objects are written into one text, which
#: bounds it whatever the size of a table.
SHEET_LINES = 500


def _joined(entries: Column, text) -> Column:
    return F.array_join(F.transform(F.array_sort(entries), text), "\n")


def _sheet() -> Column:
    return F.expr(f"CAST(line DIV {SHEET_LINES} AS INT)").alias("sheet")


def _alike(path) -> Column:
    return F.regexp_replace(path, r"\{[^}]+\}", "{}")


def _verb(method) -> Column:
    return F.upper(F.trim(F.coalesce(method, F.lit("GET"))))


def _specs(spark, sf_dir) -> DataFrame:
    """A specification per client file: its calls, and the routes that they
    meet, with a request body where a route has parameters."""
    key = ["project", "file", "sheet"]
    calls = table(spark, sf_dir, "api_calls").where("path IS NOT NULL").select("project", "file", _sheet(), _verb(F.col("method")).alias("m"), F.col("path").alias("p"), "function_name")
    routes = table(spark, sf_dir, "routes").groupBy("project", _verb(F.col("method")).alias("m"), F.col("path").alias("p")).agg(F.max(F.coalesce(F.size("params") > 0, F.lit(False))).alias("body"))
    met = calls.select(*key, _alike("p").alias("alike")).distinct().join(routes.withColumn("alike", _alike("p")), ["project", "alike"])
    back = met.groupBy(*key).agg(F.collect_set(F.struct("m", "p", "body")).alias("routes"))
    front = calls.groupBy(*key).agg(F.collect_set(F.struct("m", "p")).alias("calls"), F.collect_set("function_name").alias("names"), F.bool_and(F.col("function_name").isNotNull()).alias("all_named"))
    block = _joined(F.col("routes"), lambda r, i: F.concat(F.lit("    - id: r"), i, F.lit("\n      method: "), r["m"], F.lit("\n      path: '"), r["p"], F.lit("'"), F.when(r["body"], "\n      body:\n        id: int").otherwise("")))
    answers = _joined(F.col("routes"), lambda r, i: F.concat(F.lit("    - "), r["m"], F.lit(" answers as route "), i))
    shows = _joined(F.col("names"), lambda n: F.concat(F.lit("    - shows "), n))
    some = F.size("names") > 0
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("id: "), "spec_id"),
        F.when(some, F.concat(F.lit('title: "'), F.array_min("names"), F.lit('"'))),
        F.concat(F.lit("status: "), F.when(F.col("all_named"), "approved").otherwise("draft")),
        F.when(F.col("routes").isNotNull(), F.concat(F.lit("backend:\n  api:\n"), block, F.lit("\n  testing:\n"), answers)),
        F.concat(F.lit("frontend:\n  calls:\n"), _joined(F.col("calls"), lambda c: F.concat(F.lit("    - "), c["m"], F.lit(" "), c["p"]))),
        F.when(some, F.concat(F.lit("  testing:\n"), shows)),
    )
    both = front.join(back, key, "left").withColumn("spec_id", F.concat("project", F.lit("/"), "file", F.lit("/"), "sheet"))
    return spread(durable(both.select("spec_id", F.concat(F.lit("specs/"), "spec_id", F.lit(".yaml")).alias("file"), content.alias("content"))))


def spec_headers(spark, sf_dir):
    return spec.list_specs(_specs(spark, sf_dir))


def spec_sections(spark, sf_dir):
    return spec.sections(_specs(spark, sf_dir)).select("spec_id", "section", "type")


def spec_apis(spark, sf_dir):
    s = _specs(spark, sf_dir)
    return spec.spec_apis(s, spec.sections(s))


def spec_cases(spark, sf_dir):
    s = _specs(spark, sf_dir)
    return spec.test_cases(s, spec.sections(s))


def spec_issues(spark, sf_dir):
    return spec.validate_specs(_specs(spark, sf_dir)).select("spec_id", "part", "level", "message", "location")


def spec_summary(spark, sf_dir):
    s = _specs(spark, sf_dir)
    return spec.validation_summary(s, spec.validate_specs(s))


def spec_skeletons(spark, sf_dir):
    return spec.test_skeletons(_specs(spark, sf_dir))


def spec_active(spark, sf_dir):
    return _specs(spark, sf_dir).where(spec.is_active(F.col("content"))).select("spec_id")


def spec_status(spark, sf_dir):
    """The headers after every status was set to done."""
    changed = _specs(spark, sf_dir).withColumn("content", spec.with_status(F.col("content"), "done"))
    return spec.list_specs(changed).select("spec_id", "status")


def _sources(rows: DataFrame, ending: str, text: Column) -> DataFrame:
    """Rows of (project, file, line, ...) written as files, a line each."""
    entries = rows.select("project", "file", "line", text.alias("text")).where("text IS NOT NULL")
    grouped = entries.groupBy("project", "file", _sheet()).agg(F.collect_set(F.struct("line", "text")).alias("e"))
    return grouped.select("project", F.concat("file", F.lit("."), "sheet", F.lit(ending)).alias("path"), _joined(F.col("e"), lambda x: x["text"]).alias("content"))


def _routes(spark, sf_dir, ending: str, before: str, between: str, after: str, name: str):
    rows = table(spark, sf_dir, "routes").select("project", "file", "line", "path", F.coalesce("function_name", F.lit(name)).alias("name"))
    return _sources(rows, ending, F.concat(F.lit(before), "path", F.lit(between), "name", F.lit(after)))


def _names(spark, sf_dir, ending: str, of_function: tuple[str, str], of_class: tuple[str, str]):
    rows = table(spark, sf_dir, "symbols").select("project", F.col("path").alias("file"), "line", "name", "kind")
    text = F.when(F.col("kind") == "class", F.concat(F.lit(of_class[0]), "name", F.lit(of_class[1]))).when(F.col("kind") == "function", F.concat(F.lit(of_function[0]), "name", F.lit(of_function[1])))
    return _sources(rows, ending, text)


def django_urls(spark, sf_dir):
    files = _routes(spark, sf_dir, ".urls.py", '    path("', '", ', "),", "index")
    return fw.django_routes(files).select("project", "file", "line", "method", "path", "function_name")


def django_models(spark, sf_dir):
    """Classes as models with their direct members as fields."""
    rows = table(spark, sf_dir, "symbols").select("project", "path", "ord", "parent_ord", "name", "kind", F.col("signature").isNull().alias("bare")).distinct()
    heads = rows.where("kind = 'class' AND parent_ord IS NULL").select("project", "path", F.col("ord").alias("of"), F.col("name").alias("class"))
    members = rows.where("parent_ord IS NOT NULL").select("project", "path", F.col("parent_ord").alias("of"), F.struct("ord", "name", "bare").alias("m"))
    body = members.groupBy("project", "path", "of").agg(F.collect_set("m").alias("m"))
    line = lambda m: F.concat(F.lit("    "), m["name"], F.lit(" = models.CharField("), F.when(m["bare"], "null=True").otherwise(""), F.lit(")"))
    texts = heads.join(body, ["project", "path", "of"], "left").select(
        "project", F.concat("path", F.lit("."), "of", F.lit(".models.py")).alias("path"), F.concat_ws("\n", F.concat(F.lit("class "), "class", F.lit("(models.Model):")), _joined(F.coalesce("m", F.array()), line)).alias("content")
    )
    found = fw.django_models(texts)
    shown = F.transform("fields", lambda f: F.concat(f["name"], F.when(f["required"], "").otherwise("?")))
    return found.select("project", "file", "name", F.array_join(shown, ",").alias("fields"))


def react_pages(spark, sf_dir):
    files = _routes(spark, sf_dir, ".tsx", '<Route path="', '" element={<', " />} />", "Index")
    return fw.react_pages(files).select("project", "component_file", "line", "path", "component_name")


def react_page_files(spark, sf_dir):
    """The scanned files as pages of a framework that routes by files."""
    files = table(spark, sf_dir, "files").select("project", F.concat(F.lit("src/pages/"), F.regexp_replace("path", r"\.\w+$", ".tsx")).alias("path"), F.lit("").alias("content")).distinct()
    return fw.react_pages(files).select("project", "component_file", "path")


def react_stores(spark, sf_dir):
    files = _names(spark, sf_dir, ".ts", ("export const ", " = create(() => ({}));"), ('const s = createSlice({ name: "', '" });'))
    return fw.react_stores(files).select("project", "file", "line", "name", "kind")


def vue_pages(spark, sf_dir):
    files = _routes(spark, sf_dir, ".router.js", '  { path: "', '", component: ', " },", "Index")
    return fw.vue_pages(files).select("project", "component_file", "line", "path", "component_name")


def vue_page_files(spark, sf_dir):
    files = table(spark, sf_dir, "files").select("project", F.concat(F.lit("src/pages/"), F.regexp_replace("path", r"\.\w+$", ".vue")).alias("path"), F.lit("").alias("content")).distinct()
    return fw.vue_pages(files).select("project", "component_file", "path")


def vue_stores(spark, sf_dir):
    files = _names(spark, sf_dir, ".ts", ('const s = defineStore("', '", {});'), ("const ", " = createStore({});"))
    return fw.vue_stores(files).select("project", "file", "line", "name", "kind")


def vue_components(spark, sf_dir):
    files = _names(spark, sf_dir, ".js", ("// ", ""), ('defineComponent({ name: "', '" });'))
    return fw.vue_components(files).select("project", "file", "line", "name")


def vue_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "api_calls").where("path IS NOT NULL").select("project", "file", "line", "path", _verb(F.col("method")).alias("verb"))
    files = _sources(rows, ".vue", F.concat(F.lit("  axios."), F.lower("verb"), F.lit('("'), "path", F.lit('")')))
    return fw.vue_calls(files).select("project", "file", "line", "method", "path")


def render_calls(spark, sf_dir):
    return object_texts(table(spark, sf_dir, "api_calls").distinct(), "api_calls", ["project", "call_id"])


def render_pages(spark, sf_dir):
    files = _routes(spark, sf_dir, ".tsx", '<Route path="', '" element={<', " />} />", "Index")
    return object_texts(fw.react_pages(files), "pages", ["project", "component_file", "line"])


def render_stores(spark, sf_dir):
    files = _names(spark, sf_dir, ".ts", ("export const ", " = create(() => ({}));"), ('const s = createSlice({ name: "', '" });'))
    return object_texts(fw.react_stores(files), "stores", ["project", "file", "line"])


_SPEC_SQL = rf"""
c AS (SELECT project, file, line // {SHEET_LINES} AS sheet, project || '/' || file || '/' || (line // {SHEET_LINES}) AS spec_id, upper(trim(coalesce(method, 'GET'))) AS m, path AS p,
  regexp_replace(path, '\{{[^}}]+\}}', '{{}}', 'g') AS alike, function_name FROM api_calls WHERE path IS NOT NULL),
rt AS (SELECT project, upper(trim(coalesce(method, 'GET'))) AS m, path AS p, bool_or(coalesce(len(params), 0) > 0) AS body, regexp_replace(path, '\{{[^}}]+\}}', '{{}}', 'g') AS alike FROM routes GROUP BY ALL),
rs AS (SELECT DISTINCT spec_id, rt.m, rt.p, rt.body, rt.alike FROM c JOIN rt ON rt.project = c.project AND rt.alike = c.alike),
bk AS (SELECT *, (row_number() OVER (PARTITION BY spec_id ORDER BY m, p) - 1)::INT AS k FROM rs),
fc AS (SELECT DISTINCT spec_id, m, p, alike FROM c WHERE starts_with(p, '/') AND m IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH')),
fr AS (SELECT *, (row_number() OVER (PARTITION BY spec_id ORDER BY m, p) - 1)::INT AS k FROM fc),
nm AS (SELECT DISTINCT spec_id, function_name AS n FROM c WHERE function_name IS NOT NULL),
sp AS (SELECT spec_id, min(function_name) AS title, CASE WHEN bool_and(function_name IS NOT NULL) THEN 'approved' ELSE 'draft' END AS status, count(function_name) > 0 AS named FROM c GROUP BY 1)"""
_SECTIONS_SQL = "SELECT spec_id, 'frontend' AS section, 'frontend' AS type FROM sp UNION ALL SELECT DISTINCT spec_id, 'backend', 'backend' FROM bk"
_APIS_SQL = "SELECT spec_id, 'backend' AS section, 'backend' AS type, k AS api_ord, m AS method, p AS path, body AS has_body FROM bk UNION ALL SELECT spec_id, 'frontend', 'frontend', k, m, p, false FROM fr"
_CASES_SQL = """SELECT spec_id, 'backend' AS section, 'backend' AS type, k AS case_ord, m || ' answers as route ' || k AS "case" FROM bk
UNION ALL SELECT spec_id, 'frontend', 'frontend', (row_number() OVER (PARTITION BY spec_id ORDER BY n) - 1)::INT, 'shows ' || n FROM nm"""
_ISSUES_SQL = """SELECT spec_id, 1 AS part, 'error' AS level, 'Missing required field: title' AS message, 'top-level' AS location FROM sp WHERE NOT named
UNION ALL SELECT spec_id, 2, 'warning', m || ' ' || p || ' has no request body fields defined', 'backend.api' FROM bk WHERE m IN ('POST', 'PUT', 'PATCH') AND NOT body
UNION ALL SELECT DISTINCT spec_id, 3, 'error', '[frontend] calls ' || p || ' but no backend has a matching route', 'frontend-backend alignment' FROM fr WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.spec_id = fr.spec_id AND bk.alike = fr.alike)
UNION ALL SELECT spec_id, 5, 'warning', 'No testing section found in spec', 'testing' FROM sp WHERE NOT named AND spec_id NOT IN (SELECT spec_id FROM bk)"""


def _route_lines(ending: str, name: str) -> str:
    """Routes as the lines of the written files."""
    return f"""x AS (SELECT DISTINCT project, file || '.' || (line // {SHEET_LINES}) || '{ending}' AS file, line AS l, path AS p, coalesce(function_name, '{name}') AS n FROM routes)"""


def _symbol_lines(ending: str, kinds: str, text: str) -> str:
    """Symbols of some kinds as the lines of the written files."""
    return f"""s AS (SELECT DISTINCT project, path || '.' || (line // {SHEET_LINES}) || '{ending}' AS file, line AS l, {text} AS t, name AS n, kind FROM symbols WHERE kind IN ({kinds})),
x AS (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY l, t)::INT AS line FROM s)"""


def _numbered(order: str) -> str:
    return f"n AS (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY l, {order})::INT AS line FROM x)"


_BOTH = "'function', 'class'"
_PAGES_SQL = "WITH " + _route_lines(".tsx", "Index") + ", " + _numbered("""'<Route path="' || p || '" element={<' || n || ' />} />'""")
_STORES_SQL = "WITH " + _symbol_lines(".ts", _BOTH, """CASE kind WHEN 'class' THEN 'const s = createSlice({ name: "' || name || '" });' ELSE 'export const ' || name || ' = create(() => ({}));' END""")
_STORE_KIND = "CASE kind WHEN 'class' THEN 'redux' ELSE 'zustand' END"
_PAGE_FILES = "SELECT DISTINCT project, 'src/pages/' || regexp_replace(path, '\\.\\w+$', '.{e}') AS component_file, '/' || regexp_replace(path, '\\.\\w+$', '') AS p FROM files"

QUERIES = {
    "spec_headers": spec_headers, "spec_sections": spec_sections, "spec_apis": spec_apis, "spec_test_cases": spec_cases, "spec_issues": spec_issues, "spec_summary": spec_summary, "spec_skeletons": spec_skeletons,
    "spec_active": spec_active, "spec_status": spec_status, "django_urls": django_urls, "django_models": django_models, "react_pages": react_pages, "react_page_files": react_page_files, "react_stores": react_stores,
    "vue_pages": vue_pages, "vue_page_files": vue_page_files, "vue_stores": vue_stores, "vue_components": vue_components, "vue_calls": vue_calls, "render_api_calls": render_calls, "render_pages": render_pages,
    "render_stores": render_stores,
}

ORACLES = {
    "spec_headers": f"WITH {_SPEC_SQL} SELECT spec_id, spec_id AS id, coalesce(title, '') AS title, status, '' AS description, 'specs/' || spec_id || '.yaml' AS file FROM sp",
    "spec_sections": f"WITH {_SPEC_SQL} {_SECTIONS_SQL}",
    "spec_apis": f"WITH {_SPEC_SQL} {_APIS_SQL}",
    "spec_test_cases": f"WITH {_SPEC_SQL} {_CASES_SQL}",
    "spec_issues": f"WITH {_SPEC_SQL} {_ISSUES_SQL}",
    "spec_summary": f"WITH {_SPEC_SQL}, i AS ({_ISSUES_SQL}) SELECT sp.spec_id, count(*) FILTER (WHERE level = 'error') = 0 AS passed, count(*) FILTER (WHERE level = 'error') AS n_errors, count(*) FILTER (WHERE level = 'warning') AS n_warnings FROM sp LEFT JOIN i USING (spec_id) GROUP BY 1",
    "spec_active": f"WITH {_SPEC_SQL} SELECT spec_id FROM sp WHERE status = 'approved'",
    "spec_status": f"WITH {_SPEC_SQL} SELECT spec_id, 'done' AS status FROM sp",
    "django_urls": "WITH " + _route_lines(".urls.py", "index") + ", " + _numbered("""'    path("' || p || '", ' || n || '),'""")
    + " SELECT project, file, line, 'ALL' AS method, CASE WHEN p = '' THEN '/' ELSE '/' || trim(p, '/') END AS path, n AS function_name FROM n",
    "django_models": """WITH s AS (SELECT DISTINCT project, path, ord, parent_ord, name, kind, signature IS NULL AS bare FROM symbols),
m AS (SELECT project, path, parent_ord AS ord, list(name || CASE WHEN bare THEN '?' ELSE '' END ORDER BY ord, name, bare) AS f, list(name ORDER BY ord, name, bare) AS g FROM s WHERE parent_ord IS NOT NULL GROUP BY ALL)
SELECT h.project, h.path || '.' || h.ord || '.models.py' AS file, h.name, array_to_string(list_filter(coalesce(f, [])[1:50], lambda x: NOT starts_with(x, '_')), ',') AS fields FROM s h LEFT JOIN m USING (project, path, ord) WHERE h.kind = 'class' AND h.parent_ord IS NULL""",
    "react_pages": _PAGES_SQL + " SELECT project, file AS component_file, line, p AS path, n AS component_name FROM n",
    "react_page_files": f"SELECT project, component_file, regexp_replace(p, '\\[(\\w+)\\]', ':\\1', 'g') AS path FROM ({_PAGE_FILES.format(e='tsx')})",
    "react_stores": _STORES_SQL + f" SELECT project, file, line, n AS name, {_STORE_KIND} AS kind FROM x",
    "vue_pages": "WITH " + _route_lines(".router.js", "Index") + ", " + _numbered("""'  { path: "' || p || '", component: ' || n || ' },'""") + " SELECT project, file AS component_file, line, p AS path, n AS component_name FROM n",
    "vue_page_files": f"SELECT project, component_file, regexp_replace(p, '_(\\w+)', ':\\1', 'g') AS path FROM ({_PAGE_FILES.format(e='vue')})",
    "vue_stores": "WITH " + _symbol_lines(".ts", _BOTH, """CASE kind WHEN 'class' THEN 'const ' || name || ' = createStore({});' ELSE 'const s = defineStore("' || name || '", {});' END""")
    + " SELECT project, file, line, CASE kind WHEN 'class' THEN 'root' ELSE n END AS name, CASE kind WHEN 'class' THEN 'vuex' ELSE 'pinia' END AS kind FROM x",
    "vue_components": "WITH " + _symbol_lines(".js", _BOTH, """CASE kind WHEN 'class' THEN 'defineComponent({ name: "' || name || '" });' ELSE '// ' || name END""")
    + " SELECT project, file, min(line) AS line, arg_min(n, line) AS name FROM x WHERE kind = 'class' GROUP BY 1, 2",
    "vue_calls": f"""WITH x AS (SELECT DISTINCT project, file || '.' || (line // {SHEET_LINES}) || '.vue' AS file, line AS l, path AS p, upper(trim(coalesce(method, 'GET'))) AS m FROM api_calls WHERE path IS NOT NULL),
{_numbered('''lower(m) || '("' || p || '")' ''')} SELECT project, file, line, m AS method, p AS path FROM n WHERE (starts_with(p, '/') OR starts_with(p, 'http')) AND m IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH')""",
    "render_api_calls": """SELECT DISTINCT project, call_id, concat_ws(chr(10), '## ' || method || ' ' || path, '  file: ' || file || '  L' || line, CASE WHEN function_name <> '' THEN '  function: ' || function_name END, '') AS t FROM api_calls""",
    "render_pages": _PAGES_SQL + " SELECT project, file AS component_file, line, concat_ws(chr(10), '## ' || p, '  component: ' || file, CASE WHEN n <> '' THEN '  name: ' || n END, '') AS t FROM n",
    "render_stores": _STORES_SQL + f" SELECT project, file, line, concat_ws(chr(10), '## ' || n || ' (' || {_STORE_KIND} || ')', '  file: ' || file || '  L' || line, '') AS t FROM x",
}
