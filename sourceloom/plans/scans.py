"""Queries of scans, framework objects, consistency and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.extract import frameworks as fw
from sourceloom.extract.analysis import COMPOSE_WORDS, parse_env
from sourceloom.extract.symbols import imports_of, scan_files, symbols_of
from sourceloom.functions.text import lines
from sourceloom.operators.freshness import unmentioned_dirs, unmentioned_models, unmentioned_routes
from sourceloom.operators.mapviews import file_details, file_json, file_summaries, focused_pieces, module_key_files, module_rollup, module_texts, object_texts, scan_totals
from sourceloom.operators.traces import summarise
from sourceloom.operators.verify import roll_up
from sourceloom.plans.retrieval import _sql_lines
from sourceloom.session import spread, table
from sourceloom.streaming.traces import session_summary


def _sources(spark, sf_dir):
    return spread(table(spark, sf_dir, "sources").select("project", "path", "content"))


def _scanned(spark, sf_dir):
    """The last scan of each file."""
    rows = table(spark, sf_dir, "files").distinct()
    last = rows.groupBy("file_id").agg(F.max_by(F.struct("project", "path", "language", "lines"), F.struct("scanned_at", "lines", "language")).alias("f"))
    return last.select("f.*")


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "symbols").select("project", "path", "ord", "parent_ord", "name", "kind", "line", "signature").distinct()


def _imports(spark, sf_dir):
    return imports_of(_sources(spark, sf_dir))


def module_summary(spark, sf_dir):
    return module_rollup(_scanned(spark, sf_dir), _symbols(spark, sf_dir))


def module_top_files(spark, sf_dir):
    return module_key_files(_scanned(spark, sf_dir), _symbols(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


def modules_view(spark, sf_dir):
    return module_texts(_scanned(spark, sf_dir), _symbols(spark, sf_dir))


def _focus(spark, sf_dir):
    return _scanned(spark, sf_dir).where("language = 'go'").select("project", "path")


def focus_others(spark, sf_dir):
    """The summary side of a focused map: files without detail."""
    rest = _scanned(spark, sf_dir).join(_focus(spark, sf_dir), ["project", "path"], "left_anti")
    return file_summaries(rest, _symbols(spark, sf_dir))


def focused_view(spark, sf_dir):
    return focused_pieces(_scanned(spark, sf_dir), _symbols(spark, sf_dir), _imports(spark, sf_dir), _focus(spark, sf_dir))


def map_view(spark, sf_dir):
    return file_details(_scanned(spark, sf_dir), _symbols(spark, sf_dir), _imports(spark, sf_dir))


def map_records(spark, sf_dir):
    return file_json(_scanned(spark, sf_dir), _symbols(spark, sf_dir), _imports(spark, sf_dir))


def scan_counts(spark, sf_dir):
    files = _sources(spark, sf_dir)
    return scan_totals(scan_files(files), symbols_of(files), imports_of(files))


def scanned_lines(spark, sf_dir):
    return scan_files(table(spark, sf_dir, "sources")).groupBy("project", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("n_lines"))


def extracted_symbols(spark, sf_dir):
    return symbols_of(_sources(spark, sf_dir))


def extracted_imports(spark, sf_dir):
    return _imports(spark, sf_dir)


def py_routes(spark, sf_dir):
    return fw.fastapi_routes(_sources(spark, sf_dir)).select("project", "file", "line", "method", "path", "function_name", F.array_join("params", "|").alias("params"))


def py_models(spark, sf_dir):
    return fw.fastapi_models(_sources(spark, sf_dir)).select("project", "file", "line", "name", "kind")


def py_model_fields(spark, sf_dir):
    return fw.fastapi_models(_sources(spark, sf_dir)).select("project", "file", "line", F.size("fields").alias("n_fields"), F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("fields"))


def django_urls(spark, sf_dir):
    return fw.django_routes(_sources(spark, sf_dir))


def js_routes(spark, sf_dir):
    return fw.express_routes(_sources(spark, sf_dir)).select("project", "file", "line", "method", "path")


def ts_models(spark, sf_dir):
    return fw.express_models(_sources(spark, sf_dir)).select("project", "file", "line", "kind", "name")


def ts_model_fields(spark, sf_dir):
    return fw.express_models(_sources(spark, sf_dir))


def js_calls(spark, sf_dir):
    return fw.react_calls(_sources(spark, sf_dir)).select("project", "file", "line", "method", "path")


def component_table(spark, sf_dir):
    return fw.react_components(_sources(spark, sf_dir))


def brace_depth(spark, sf_dir):
    """Depth of braces at the end of each line of TypeScript files."""
    files = spread(table(spark, sf_dir, "sources").where(F.col("path").endswith(".ts")).select("file_id", "content"))
    step = F.transform(lines(F.col("content")), lambda x: F.length(F.translate(x, "}", "")) - F.length(F.translate(x, "{", "")))
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<int>").alias("out"))
    running = F.aggregate(step, start, lambda acc, x: F.struct((acc["d"] + x).alias("d"), F.concat(acc["out"], F.array(acc["d"] + x)).alias("out")), lambda acc: acc["out"])
    return files.select("file_id", F.posexplode(running).alias("ln", "depth"))


def env_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "evidence").where(F.col("uri").endswith(".env")).select("evidence_id", "content").distinct()
    return parse_env(rows, ["evidence_id"])


def keyword_infra(spark, sf_dir):
    """The first document of a project that has each word of infrastructure."""
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("source").alias("project"), F.lower("text").alias("text")))
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("name"), F.lit(k).alias("kind")) for w, n, k in COMPOSE_WORDS])
    found = docs.select("doc_id", "project", F.inline(F.filter(words, lambda x: F.contains(F.col("text"), x["word"]))))
    return found.groupBy("project", "name", "kind").agg(F.min("doc_id").alias("doc_id"))


def _context(spark, sf_dir):
    """The first documentation page of a project stands for its context."""
    docs = table(spark, sf_dir, "documents").where(F.col("path").startswith("docs/") & F.col("text").isNotNull())
    first = docs.groupBy(F.col("source").alias("project")).agg(F.min_by("text", "doc_id").alias("content"))
    return first.withColumn("name", F.explode(F.array(*[F.lit(n) for n in ("api-contracts.md", "modules.md", "data-models.md")])))


def route_freshness(spark, sf_dir):
    return unmentioned_routes(table(spark, sf_dir, "routes").select("project", "method", "path").distinct(), _context(spark, sf_dir))


def dir_freshness(spark, sf_dir):
    return unmentioned_dirs(table(spark, sf_dir, "files"), _context(spark, sf_dir))


def model_freshness(spark, sf_dir):
    classes = table(spark, sf_dir, "symbols").where("kind = 'class'").select("project", "name").distinct()
    return unmentioned_models(classes, _context(spark, sf_dir))


def path_alignment(spark, sf_dir):
    """Called paths without a route of the same project, parameters in braces
    of any name alike."""
    calls = table(spark, sf_dir, "api_calls").where("path IS NOT NULL AND NOT startswith(path, 'http')").select("project", "path").distinct()
    routes = table(spark, sf_dir, "routes").select("project", F.regexp_replace("path", r"\{[^}]+\}", "{}").alias("alike")).distinct()
    return calls.withColumn("alike", F.regexp_replace("path", r"\{[^}]+\}", "{}")).join(routes, ["project", "alike"], "left_anti").select("project", "path")


def render_routes(spark, sf_dir):
    return object_texts(table(spark, sf_dir, "routes").distinct(), "routes", ["project", "route_id"])


def render_env(spark, sf_dir):
    return object_texts(table(spark, sf_dir, "env_vars").distinct(), "env_vars", ["project", "env_id"])


def trace_summary(spark, sf_dir):
    """Events read as runs, summed up by type."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    runs = e.select("event_type", (n % 900).alias("compressed_tokens"), (n % 2000).alias("chunks_total_tokens"), (n % 5000).alias("total_input_tokens"), (n % 3000).alias("packed_tokens"), (n % 64 / 16).alias("total_time_s"))
    return summarise(runs, ["event_type"])


def verify_rollup(spark, sf_dir):
    checks = table(spark, sf_dir, "files").distinct().select("project", (F.coalesce("lines", F.lit(0)) > 10).alias("passed"))
    return roll_up(checks, ["project"])


def event_sessions(spark, sf_dir):
    out = session_summary(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    return out.select("user_id", F.unix_seconds("session.start").alias("start_s"), "n", F.round("total", 4).alias("total"))


_LN = _sql_lines("content")
_SCAN_SQL = """
fl AS (SELECT DISTINCT * FROM files),
rk AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, lines DESC NULLS LAST, language DESC NULLS LAST) AS k FROM fl),
sc AS (SELECT project, path, language, lines FROM rk WHERE k = 1),
sy AS (SELECT DISTINCT project, path, ord, parent_ord, name, kind, line, signature FROM symbols),
ct AS (SELECT project, path, count(*) AS n_symbols, string_agg(name, ',' ORDER BY ord) AS all_names, list(name ORDER BY ord) AS names FROM sy WHERE parent_ord IS NULL GROUP BY 1, 2),
fs AS (SELECT sc.*, coalesce(n_symbols, 0) AS n_symbols, ct.names, CASE WHEN contains(sc.path, '/') THEN string_split(sc.path, '/')[1] ELSE '(root)' END AS module FROM sc LEFT JOIN ct USING (project, path))"""


def _line_sql(extensions: str) -> str:
    return f"l AS (SELECT project, path AS file, {_LN} AS ls FROM sources WHERE regexp_matches(path, '\\.({extensions})$')), x AS (SELECT project, file, ls, unnest(ls) AS text, unnest(generate_series(1, len(ls)))::INT AS line FROM l)"


_CONTEXT_SQL = "cx AS (SELECT source AS project, arg_min(text, doc_id) AS doc FROM documents WHERE path LIKE 'docs/%' AND text IS NOT NULL GROUP BY 1)"
_LIVE_SQL = rf"lv AS (SELECT project, doc FROM cx WHERE len(list_filter({_sql_lines('doc')}, lambda s: NOT (trim(s) = '' OR starts_with(trim(s), '#') OR (starts_with(trim(s), '<!--') AND ends_with(trim(s), '-->'))))) > 0)"

QUERIES = {
    "module_rollup": module_summary, "module_top_files": module_top_files, "modules_view": modules_view, "focus_others": focus_others, "focused_map": focused_view,
    "repo_map": map_view, "repo_map_json": map_records, "scan_counts": scan_counts, "scanned_lines": scanned_lines, "symbols_extracted": extracted_symbols, "imports_extracted": extracted_imports,
    "fastapi_routes": py_routes, "fastapi_models": py_models, "fastapi_model_fields": py_model_fields, "django_routes": django_urls, "express_routes": js_routes, "express_models": ts_models,
    "express_model_fields": ts_model_fields, "react_calls": js_calls, "react_components": component_table, "brace_depth": brace_depth, "env_lines": env_lines, "keyword_infra": keyword_infra,
    "route_freshness": route_freshness, "dir_freshness": dir_freshness, "model_freshness": model_freshness, "path_alignment": path_alignment, "render_routes": render_routes, "render_env_vars": render_env,
    "trace_summary": trace_summary, "verify_rollup": verify_rollup, "event_sessions": event_sessions,
}

ORACLES = {
    "module_rollup": f"WITH {_SCAN_SQL} SELECT project, module, count(*) AS n_files, sum(n_symbols)::BIGINT AS n_symbols, sum(lines)::BIGINT AS n_lines FROM fs GROUP BY 1, 2",
    "module_top_files": f"""WITH {_SCAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project, module ORDER BY n_symbols DESC,
  list_transform(string_split(path, '/'), lambda s, i: {{'d': (i < len(string_split(path, '/')))::INT, 'n': s}})) AS rank FROM fs WHERE names IS NOT NULL)
SELECT project, module, rank::INT AS rank, path, n_symbols, array_to_string(names[1:3], ',') AS names FROM r WHERE rank <= 5""",
    "focus_others": f"WITH {_SCAN_SQL} SELECT project, path, language, lines, n_symbols FROM fs WHERE language IS DISTINCT FROM 'go'",
    "scanned_lines": """SELECT project, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language,
  count(*) AS n, sum(len(content) - len(replace(content, chr(10), '')) + CASE WHEN octet_length(encode(content)) > 512000 THEN 0 ELSE 1 END)::BIGINT AS n_lines FROM sources WHERE regexp_matches(path, '\\.(py|js|ts|go|rs|java)$') GROUP BY 1, 2""",
    "fastapi_routes": rf"""WITH {_line_sql('py')}, r AS (SELECT *, list_filter(ls[line + 1 : line + 4], lambda s: regexp_matches(s, '{fw.PY_DEF}'))[1] AS h FROM x WHERE regexp_matches(text, '{fw.PY_ROUTE.replace("'", "''")}')),
q AS (SELECT *, regexp_extract(coalesce(h, ''), '{fw.PY_DEF}', 2) AS raw FROM r)
SELECT project, file, line, upper(regexp_extract(text, '{fw.PY_ROUTE.replace("'", "''")}', 1)) AS method, regexp_extract(text, '{fw.PY_ROUTE.replace("'", "''")}', 2) AS path,
  regexp_extract(coalesce(h, ''), '{fw.PY_DEF}', 1) AS function_name,
  array_to_string(list_transform(list_filter(list_transform(string_split(raw, ','), lambda p: trim(p)), lambda p: p <> '' AND p <> 'self' AND NOT starts_with(p, '*') AND NOT contains(p, 'Depends(') AND NOT contains(p, 'Security(') AND contains(p, ':')),
    lambda p: trim(regexp_extract(p, '^([^:]*):', 1)) || ': ' || trim(regexp_extract(p, '^[^:]*:([^=]*)', 1))), '|') AS params FROM q""",
    "fastapi_models": rf"WITH {_line_sql('py')} SELECT project, file, line, regexp_extract(text, '{fw.PY_MODEL}', 1) AS name, CASE regexp_extract(text, '{fw.PY_MODEL}', 2) WHEN 'BaseModel' THEN 'model' WHEN 'SQLModel' THEN 'entity' ELSE 'config' END AS kind FROM x WHERE regexp_matches(text, '{fw.PY_MODEL}')",
    "fastapi_model_fields": rf"""WITH {_line_sql('py')}, m AS (SELECT project, file, line, ls[line + 1 : line + 50] AS nx FROM x WHERE regexp_matches(text, '{fw.PY_MODEL}')),
c AS (SELECT *, list_position(list_transform(nx, lambda s: s <> '' AND NOT regexp_matches(s, '^\s') AND NOT starts_with(s, '#')), true) AS stop FROM m),
b AS (SELECT project, file, line, list_filter(CASE WHEN stop > 0 THEN nx[1 : stop - 1] ELSE nx END, lambda s: regexp_matches(s, '{fw.PY_FIELD}') AND NOT starts_with(regexp_extract(s, '{fw.PY_FIELD}', 1), '_')) AS f FROM c)
SELECT project, file, line, len(f)::INT AS n_fields, array_to_string(list_transform(f, lambda s: regexp_extract(s, '{fw.PY_FIELD}', 1)), ',') AS fields FROM b""",
    "express_routes": rf"""WITH {_line_sql('js|ts|mjs')} SELECT project, file, line, upper(regexp_extract(text, '{fw.JS_ROUTE.replace("'", "''")}', 1)) AS method, regexp_extract(text, '{fw.JS_ROUTE.replace("'", "''")}', 2) AS path FROM x WHERE regexp_matches(text, '{fw.JS_ROUTE.replace("'", "''")}')""",
    "express_models": rf"""WITH {_line_sql('ts|js')}, k AS (SELECT *, CASE WHEN regexp_matches(text, '{fw.TS_INTERFACE}') THEN 'interface' WHEN regexp_matches(text, '{fw.TS_TYPE}') THEN 'type' WHEN regexp_matches(text, '{fw.MONGOOSE.replace("'", "''")}') THEN 'schema' END AS kind FROM x),
n AS (SELECT *, CASE kind WHEN 'interface' THEN regexp_extract(text, '{fw.TS_INTERFACE}', 1) WHEN 'type' THEN regexp_extract(text, '{fw.TS_TYPE}', 1) ELSE regexp_extract(text, '{fw.MONGOOSE.replace("'", "''")}', 1) END AS name FROM k WHERE kind IS NOT NULL)
SELECT project, file, line, kind, name FROM n WHERE name <> ''""",
    "react_calls": rf"""WITH {_line_sql('jsx|tsx|js|ts')}, c AS (SELECT *, regexp_matches(text, '{fw.REACT_CALL.replace("'", "''")}') AS client FROM x WHERE regexp_matches(text, '{fw.REACT_CALL.replace("'", "''")}') OR regexp_matches(text, '{fw.FETCH_CALL.replace("'", "''")}')),
d AS (SELECT *, CASE WHEN client THEN coalesce(nullif(upper(regexp_extract(text, '{fw.REACT_CALL.replace("'", "''")}', 1)), ''), 'GET') WHEN contains(text, 'method') AND (contains(text, 'POST') OR contains(text, 'post')) THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN client THEN regexp_extract(text, '{fw.REACT_CALL.replace("'", "''")}', 2) ELSE regexp_extract(text, '{fw.FETCH_CALL.replace("'", "''")}', 1) END AS path FROM c)
SELECT project, file, line, method, path FROM d WHERE starts_with(path, '/') OR starts_with(path, 'http')""",
    "brace_depth": f"""WITH l AS (SELECT file_id, {_LN} AS ls FROM sources WHERE path LIKE '%.ts'), x AS (SELECT file_id, unnest(ls) AS text, unnest(generate_series(1, len(ls)))::INT - 1 AS ln FROM l)
SELECT file_id, ln, sum(len(replace(text, '}}', '')) - len(replace(text, '{{', ''))) OVER (PARTITION BY file_id ORDER BY ln)::INT AS depth FROM x""",
    "env_lines": rf"""WITH e AS (SELECT DISTINCT evidence_id, content FROM evidence WHERE uri LIKE '%.env'), l AS (SELECT evidence_id, {_LN} AS ls FROM e), x AS (SELECT evidence_id, trim(unnest(ls)) AS t, unnest(generate_series(1, len(ls)))::INT - 1 AS ord FROM l)
SELECT evidence_id, ord, trim(regexp_extract(t, '^([^=]*)=', 1)) AS name, trim(regexp_extract(t, '^[^=]*=(.*)$', 1)) AS default_value FROM x WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '=')""",
    "keyword_infra": "WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{n}', '{k}')" for w, n, k in COMPOSE_WORDS) + ") AS v(word, name, kind)) SELECT source AS project, name, kind, min(doc_id) AS doc_id FROM documents, w WHERE contains(lower(text), word) GROUP BY 1, 2, 3",
    "route_freshness": f"WITH {_CONTEXT_SQL}, {_LIVE_SQL} SELECT project, method, path FROM (SELECT DISTINCT project, method, path FROM routes) r JOIN lv USING (project) WHERE NOT contains(doc, path)",
    "dir_freshness": f"WITH {_CONTEXT_SQL}, {_LIVE_SQL} SELECT project, dir FROM (SELECT DISTINCT project, string_split(path, '/')[1] AS dir FROM files WHERE contains(path, '/')) r JOIN lv USING (project) WHERE NOT contains(doc, dir) AND dir NOT IN ('tests', 'test', 'docs', 'scripts')",
    "model_freshness": f"WITH {_CONTEXT_SQL}, {_LIVE_SQL} SELECT project, name FROM (SELECT DISTINCT project, name FROM symbols WHERE kind = 'class') r JOIN lv USING (project) WHERE NOT contains(doc, name)",
    "path_alignment": r"""WITH r AS (SELECT DISTINCT project, regexp_replace(path, '\{[^}]+\}', '{}', 'g') AS alike FROM routes)
SELECT DISTINCT project, path FROM api_calls c WHERE path IS NOT NULL AND NOT starts_with(path, 'http') AND NOT EXISTS (SELECT 1 FROM r WHERE r.project = c.project AND r.alike = regexp_replace(c.path, '\{[^}]+\}', '{}', 'g'))""",
    "modules_view": f"""WITH {_SCAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project, module ORDER BY n_symbols DESC,
  list_transform(string_split(path, '/'), lambda s, i: {{'d': (i < len(string_split(path, '/')))::INT, 'n': s}})) AS rank FROM fs WHERE names IS NOT NULL),
t AS (SELECT project, module, 0 AS rank, '## ' || module || '/' || chr(10) || '  files: ' || count(*) || ', symbols: ' || sum(n_symbols)::BIGINT || ', lines: ' || sum(lines)::BIGINT AS t FROM fs GROUP BY 1, 2
  UNION ALL SELECT project, module, rank, '  ' || path || ': ' || array_to_string(names[1:3], ', ') FROM r WHERE rank <= 5)
SELECT project, module, string_agg(t, chr(10) ORDER BY rank) AS t FROM t WHERE t IS NOT NULL GROUP BY 1, 2""",
    "render_routes": """SELECT DISTINCT project, route_id, '## ' || method || ' ' || path || chr(10) || '  file: ' || file || '  L' || line || chr(10)
  || CASE WHEN function_name <> '' THEN '  handler: ' || function_name || chr(10) ELSE '' END || CASE WHEN len(params) > 0 THEN '  params:' || chr(10) || '    ' || array_to_string(params, chr(10) || '    ') || chr(10) ELSE '' END AS t FROM routes""",
    "render_env_vars": """SELECT DISTINCT project, env_id, '  ' || name || CASE WHEN default_value <> '' THEN ' = ' || default_value ELSE '' END || CASE WHEN description <> '' THEN chr(10) || '    # ' || description ELSE '' END
  || CASE WHEN source <> '' THEN chr(10) || '    source: ' || source ELSE '' END AS t FROM env_vars""",
    "trace_summary": """WITH r AS (SELECT event_type, event_id % 900 AS c, event_id % 2000 AS g, event_id % 5000 AS i, event_id % 3000 AS p, (event_id % 64) / 16.0::DOUBLE AS t FROM events)
SELECT event_type, count(*) AS total_runs, sum(i)::BIGINT AS total_input_tokens, sum(p)::BIGINT AS total_packed_tokens, (sum(i) - sum(p))::BIGINT AS total_tokens_saved, round_even(coalesce(sum(c)::DOUBLE / nullif(sum(g), 0), 0), 3) AS avg_compression_ratio,
  round_even(sum(p)::DOUBLE / count(*), 0)::BIGINT AS avg_packed_tokens, round_even(sum(t) / count(*), 2) AS avg_time_s, round_even(sum(t), 2) AS total_time_s FROM r GROUP BY 1""",
    "verify_rollup": "SELECT project, bool_and(coalesce(lines, 0) > 10) AS passed, count(*) AS n_checks, count(*) FILTER (WHERE NOT coalesce(lines, 0) > 10) AS n_failed FROM (SELECT DISTINCT * FROM files) GROUP BY 1",
    "event_sessions": """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""",
}
