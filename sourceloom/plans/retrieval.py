"""Queries of chunking, indexing, ranking, compression and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceloom.functions.text import lines, newline_count, path_filter, rough_tokens, source_type
from sourceloom.operators.chunking import line_windows
from sourceloom.operators.compress import compress, kept_lines, scored_lines
from sourceloom.operators.index import build_index, query_index, symbol_windows, window_symbols
from sourceloom.operators.rank import search, search_workspace, top_bm25
from sourceloom.operators.slots import greedy_pack, pack_stats, render_prompt
from sourceloom.session import spread, table

QUERY = "decode the pending route snapshot"
BAG_QUERY = "invoice invoice cursor retry budgetLimit"

#: SQL for DuckDB: lines as Python's splitlines gives them, and tokens.
_LINES = r"""regexp_split_to_array({c}, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"""


def _sql_lines(column: str) -> str:
    ls = _LINES.format(c=column)
    return f"(CASE WHEN {ls}[-1] = '' THEN {ls}[:-2] ELSE {ls} END)"


def _sql_tokens(column: str) -> str:
    part = r"regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+\b|[0-9]+')"
    return rf"list_transform(flatten(list_transform(regexp_extract_all({column}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: CASE WHEN len({part}) > 0 THEN {part} ELSE [w] END)), lambda t: lower(t))"


def _files(spark, sf_dir):
    return spread(table(spark, sf_dir, "sources"))


def _documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("source").alias("project"), F.col("doc_id").alias("doc_key"), F.col("text").alias("content"))


def _windows(spark, sf_dir):
    windows = line_windows(_files(spark, sf_dir), keep=("file_id", "project", "path"))
    return windows.withColumn("doc_key", F.col("file_id") * 100000 + F.col("window_no"))


def line_stats(spark, sf_dir):
    files = table(spark, sf_dir, "sources")
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(newline_count(F.col("content"))).alias("scan_lines"), F.sum(F.size(lines(F.col("content")))).alias("split_lines"), F.sum(F.octet_length("content")).alias("n_bytes")
    )


def chunk_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("file_id", "window_no", "start_line", "end_line", "source_type", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


def chunk_windows_small(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return line_windows(docs, 8, 2, ("doc_id",), "text").select("doc_id", "window_no", "start_line", "end_line", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


def term_counts(spark, sf_dir):
    return build_index(_documents(spark, sf_dir)).postings.select("doc_key", "term", "tf", "dl")


def doc_freq(spark, sf_dir):
    return build_index(_documents(spark, sf_dir)).term_stats


def corpus_stats(spark, sf_dir):
    return build_index(_documents(spark, sf_dir)).sizes.select("project", "n", F.round("avg_dl", 6).alias("avg_dl"))


def bm25_topk(spark, sf_dir):
    return top_bm25(query_index(_documents(spark, sf_dir), QUERY), QUERY, 20).select("project", "doc_key", "rank", F.round("bm25", 6).alias("bm25"))


def bm25_bag_query(spark, sf_dir):
    return top_bm25(query_index(_documents(spark, sf_dir), BAG_QUERY), BAG_QUERY, 20).select("project", "doc_key", "rank", F.round("bm25", 6).alias("bm25"))


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "symbols").select("project", "path", "ord", "parent_ord", "name", "line").distinct()


def symbol_chunks(spark, sf_dir):
    return symbol_windows(_windows(spark, sf_dir), _symbols(spark, sf_dir)).select("doc_key", "name_lower")


def chunk_symbols(spark, sf_dir):
    return window_symbols(_windows(spark, sf_dir), _symbols(spark, sf_dir)).select("doc_key", F.array_join("symbols", ",").alias("symbols"))


HYBRID_QUERY = "conflict harvest parse pending_budget snapshot"


def _name_windows(spark, sf_dir):
    """Symbols by their names, and by the last words of those that have several,
    so that query words, which are split, can meet them too."""
    last = F.regexp_extract("name", r"([A-Z]?[a-z]+|[A-Z]+)[\d_]*$", 1)
    named = _symbols(spark, sf_dir).withColumn("name", F.explode(F.array_distinct(F.array("name", F.when(last == "", F.col("name")).otherwise(last)))))
    return symbol_windows(_windows(spark, sf_dir), named)


def hybrid_search(spark, sf_dir):
    index = query_index(_windows(spark, sf_dir), HYBRID_QUERY)
    return search(index, _name_windows(spark, sf_dir), HYBRID_QUERY, 10).select("project", "doc_key", "final_rank", F.round("score", 6).alias("score"))


def workspace_search(spark, sf_dir):
    index = query_index(_windows(spark, sf_dir), HYBRID_QUERY)
    return search_workspace(index, _name_windows(spark, sf_dir), HYBRID_QUERY, 25).select("project", "doc_key", F.round("score", 6).alias("score"))


COMPRESS_QUERY = "state ledger return warm secret"


def _evidence(spark, sf_dir):
    return spread(table(spark, sf_dir, "evidence").select("evidence_id", "uri", "content")).distinct()


def line_relevance_scores(spark, sf_dir):
    return scored_lines(_evidence(spark, sf_dir), COMPRESS_QUERY, ["evidence_id"]).select("evidence_id", "ln", F.round("relevance", 6).alias("relevance"))


def compress_keep(spark, sf_dir):
    return kept_lines(_evidence(spark, sf_dir), COMPRESS_QUERY, ["evidence_id"]).select("evidence_id", "ln", "keep")


def compress_markers(spark, sf_dir):
    return compress(_evidence(spark, sf_dir), COMPRESS_QUERY, ["evidence_id"]).select("evidence_id", F.md5(F.encode("compressed", "utf-8")).alias("compressed_md5"))


def source_classify(spark, sf_dir):
    files = table(spark, sf_dir, "sources")
    return files.groupBy(source_type(F.col("path")).alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


def glob_filter(spark, sf_dir):
    files = table(spark, sf_dir, "sources")
    return files.where(path_filter(F.col("path"), ["src/", "*.go"], ["*generator*", "src/core"])).select("file_id")


#: A small budget, so that the evidence of one file has to be trimmed.
BUDGET = 150


def _slots(spark, sf_dir):
    """Evidence of one file as the slots of a prompt."""
    rows = table(spark, sf_dir, "evidence").select("project", "uri", "evidence_id", "source_type", "content").distinct()
    kinds = F.create_map(F.lit("config"), F.lit(100), F.lit("code"), F.lit(80), F.lit("test"), F.lit(50), F.lit("doc"), F.lit(10))
    return rows.select(
        F.concat_ws(":", "project", "uri").alias("prompt_id"), F.concat(F.lit("e"), F.col("evidence_id")).alias("name"), "content",
        F.coalesce(kinds[F.col("source_type")], F.lit(50)).alias("priority"), F.lit(0.0).alias("budget_pct"), F.col("evidence_id").cast("int").alias("insert_ord"),
    )


def pack_prompts(spark, sf_dir):
    return greedy_pack(_slots(spark, sf_dir), BUDGET).select("prompt_id", "name", "tokens", "used", "fate")


def pack_totals(spark, sf_dir):
    return pack_stats(_slots(spark, sf_dir), BUDGET).select("prompt_id", "budget", "total_before_trim", "over_budget", F.size("slots").alias("n_slots"))


def prompts(spark, sf_dir):
    return render_prompt(greedy_pack(_slots(spark, sf_dir), BUDGET)).select("prompt_id", rough_tokens(F.col("prompt")).alias("n_tokens"), F.md5(F.encode("prompt", "utf-8")).alias("prompt_md5"))


_WINDOWS_SQL = f"""
l AS (SELECT file_id, project, path, {_sql_lines('content')} AS ls FROM sources),
w AS (SELECT file_id, project, path, ls, unnest(generate_series(0, greatest(ceil((len(ls) - 40) / 30.0), 0)::INT)) AS window_no FROM l WHERE len(ls) > 0),
win AS (SELECT file_id, project, path, window_no, file_id * 100000 + window_no AS doc_key, (window_no * 30 + 1)::INT AS start_line,
  (window_no * 30 + len(ls[window_no * 30 + 1 : window_no * 30 + 40]))::INT AS end_line, array_to_string(ls[window_no * 30 + 1 : window_no * 30 + 40], chr(10)) AS content,
  CASE WHEN lower(path) LIKE '%test%' THEN 'test' WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'doc'
    WHEN regexp_matches(lower(path), '\\.(toml|yaml|yml|json|cfg|ini)$') THEN 'config' ELSE 'code' END AS source_type FROM w)"""

_INDEX_SQL = f"""
tk AS (SELECT project, doc_key, coalesce({_sql_tokens('content')}, []) AS t FROM d),
sizes AS (SELECT project, count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avg_dl FROM tk GROUP BY 1),
po AS (SELECT project, doc_key, len(t) AS dl, unnest(t) AS term FROM tk),
postings AS (SELECT project, doc_key, dl::INT AS dl, term, count(*) AS tf FROM po GROUP BY ALL),
term_stats AS (SELECT project, term, count(*) AS df FROM postings GROUP BY ALL)"""

_DOCS_SQL = "d AS (SELECT source AS project, doc_id AS doc_key, text AS content FROM documents)"


def _bm25_sql(words: list[str], top: int) -> str:
    bag = ", ".join(f"('{w}')" for w in words)
    return f"""
q AS (SELECT term, count(*) AS mult FROM (VALUES {bag}) AS v(term) GROUP BY 1),
sc AS (SELECT p.project, p.doc_key, sum(q.mult * ln((s.n - ts.df + 0.5) / (ts.df + 0.5) + 1.0) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * p.dl / s.avg_dl))) AS bm25
  FROM postings p JOIN q USING (term) JOIN term_stats ts ON ts.project = p.project AND ts.term = p.term JOIN sizes s ON s.project = p.project GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY bm25 DESC, doc_key) AS rank FROM sc WHERE bm25 > 0),
top AS (SELECT * FROM rk WHERE rank <= {top})"""


_SYMBOLS_SQL = "sy AS (SELECT DISTINCT project, path, ord, parent_ord, name, line FROM symbols)"
_NAMES_SQL = r"""nm AS (SELECT project, path, name, line FROM sy UNION SELECT project, path, regexp_extract(name, '([A-Z]?[a-z]+|[A-Z]+)[\d_]*$', 1), line FROM sy WHERE regexp_matches(name, '([A-Z]?[a-z]+|[A-Z]+)[\d_]*$')),
sw AS (SELECT DISTINCT win.project, doc_key, lower(name) AS name_lower FROM win JOIN nm ON nm.project = win.project AND nm.path = win.path AND line BETWEEN start_line AND end_line)"""

_HYBRID_WORDS = ["conflict", "harvest", "parse", "pending", "budget", "snapshot"]

_FUSE_SQL = f"""
qp AS (SELECT term, min(pos) AS first_pos, count(*) AS mult FROM (VALUES {', '.join(f"('{w}', {k})" for k, w in enumerate(_HYBRID_WORDS))}) AS v(term, pos) GROUP BY 1),
sh AS (SELECT project, doc_key, sum(mult) AS hits, min(first_pos) AS first_pos FROM sw JOIN qp ON name_lower = term GROUP BY 1, 2),
fu AS (SELECT coalesce(top.project, sh.project) AS project, coalesce(top.doc_key, sh.doc_key) AS doc_key, bm25, rank, hits, first_pos
  FROM top FULL JOIN sh ON top.project = sh.project AND top.doc_key = sh.doc_key),
fs AS (SELECT *, coalesce(bm25 / max(bm25) OVER (PARTITION BY project) * 0.6::DOUBLE, 0::DOUBLE) + coalesce(hits::DOUBLE / max(hits) OVER (PARTITION BY project) * 0.4::DOUBLE, 0::DOUBLE) AS score FROM fu),
fr AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, rank ASC NULLS LAST, first_pos ASC NULLS LAST, doc_key) AS final_rank FROM fs)"""

_KEEP_SQL = " OR ".join(
    f"regexp_matches(line, '{p}')"
    for p in (r"(?i)^\s*(def |class |async def )", r"^\s*(import |from .+ import )", r"^\s*(raise |except |finally:)", r"^\s*(return |yield )", r"^\s*@", r"^\s*(if __name__|assert )", r"(?i)#\s*(TODO|FIXME|HACK|BUG|XXX|NOTE)", r"^\s*(interface |struct |enum |type |func |fn |pub fn )")
)
_MARKS = r"(TODO|FIXME|HACK|BUG|XXX|NOTE)"
_DROP_SQL = (
    rf"(regexp_matches(line, '^\s*#') AND NOT regexp_matches(line, '^\s*#\s*{_MARKS}')) OR (regexp_matches(line, '^\s*//') AND NOT regexp_matches(line, '^\s*//\s*{_MARKS}')) OR "
    + " OR ".join(f"regexp_matches(line, '{p}')" for p in (r'^\s*"""', r"^\s*''''''", r"^\s*(pass|\.\.\.)\s*$", r"^\s*$", r"^\s*(logger\.|logging\.|log\.)", r"^\s*print\("))
)
_SCORED_SQL = f"""
WITH e AS (SELECT DISTINCT evidence_id, uri, content FROM evidence),
el AS (SELECT evidence_id, {_sql_lines('content')} AS ls FROM e),
ll AS (SELECT evidence_id, len(ls)::INT AS n_lines, unnest(ls) AS line, (unnest(generate_series(1, len(ls))) - 1)::INT AS ln FROM el),
sc AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN {_KEEP_SQL} THEN 0.3::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN shared > 0 THEN 0.4::DOUBLE * (shared / 5.0::DOUBLE) ELSE 0::DOUBLE END) - (CASE WHEN {_DROP_SQL} THEN 0.2::DOUBLE ELSE 0::DOUBLE END))) AS relevance
  FROM (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-zA-Z_][a-zA-Z0-9_]*')), ['state', 'ledger', 'return', 'warm', 'secret'])) AS shared FROM ll))"""
_KEPT_SQL = (
    _SCORED_SQL
    + """,
hit AS (SELECT *, (relevance >= 0.1::DOUBLE)::INT AS h FROM sc),
near AS (SELECT *, max(h) OVER (PARTITION BY evidence_id ORDER BY ln ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM hit),
cnt AS (SELECT *, sum(near) OVER (PARTITION BY evidence_id) AS n_near, row_number() OVER (PARTITION BY evidence_id, near ORDER BY relevance, ln) AS lowest FROM near),
kept AS (SELECT evidence_id, ln, line, n_lines, (n_lines <= 5 OR (near = 1 AND lowest > greatest(n_near - greatest(3, floor(n_lines * 0.5)::INT), 0))) AS keep FROM cnt)"""
)
_MARKERS_SQL = (
    _KEPT_SQL
    + """,
runs AS (SELECT *, CASE WHEN NOT keep THEN ln - row_number() OVER (PARTITION BY evidence_id, keep ORDER BY ln) END AS run FROM kept),
shown AS (SELECT evidence_id, min(ln) AS ln, CASE WHEN keep THEN min(line) ELSE '    [...' || count(*) || ' lines omitted...]' END AS txt
  FROM runs GROUP BY evidence_id, keep, CASE WHEN keep THEN ln ELSE run END),
joined AS (SELECT evidence_id, string_agg(txt, chr(10) ORDER BY ln) AS compressed FROM shown GROUP BY 1)
SELECT j.evidence_id, md5(CASE WHEN len(el.ls) <= 5 THEN e.content ELSE j.compressed END) AS compressed_md5 FROM joined j JOIN e USING (evidence_id) JOIN el USING (evidence_id)"""
)

_SLOTS_SQL = r"""
sl AS (SELECT DISTINCT project || ':' || uri AS prompt_id, 'e' || evidence_id AS name, content,
  CASE source_type WHEN 'config' THEN 100 WHEN 'code' THEN 80 WHEN 'test' THEN 50 WHEN 'doc' THEN 10 ELSE 50 END AS priority, evidence_id AS insert_ord FROM evidence WHERE content <> ''),
sz AS (SELECT prompt_id, name, priority, insert_ord, len(regexp_extract_all(content, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) AS tokens FROM sl)"""
_PACK_SQL = f"""
WITH RECURSIVE {_SLOTS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY priority DESC, insert_ord) AS k, sum(tokens) OVER (PARTITION BY prompt_id) AS total FROM sz),
f AS (
  SELECT prompt_id, name, k, tokens, total, CASE WHEN total <= {BUDGET} OR tokens <= {BUDGET} THEN tokens WHEN {BUDGET} > 50 THEN {BUDGET} ELSE 0 END AS used, {BUDGET} AS before FROM o WHERE k = 1
  UNION ALL
  SELECT o.prompt_id, o.name, o.k, o.tokens, o.total,
    CASE WHEN o.total <= {BUDGET} OR o.tokens <= f.before - f.used THEN o.tokens WHEN f.before - f.used > 50 THEN f.before - f.used ELSE 0 END, f.before - f.used
  FROM f JOIN o ON o.prompt_id = f.prompt_id AND o.k = f.k + 1)
SELECT prompt_id, name, tokens::BIGINT AS tokens, used::BIGINT AS used, CASE WHEN total <= {BUDGET} OR tokens <= before THEN 'whole' WHEN before > 50 THEN 'cut' ELSE 'dropped' END AS fate FROM f"""

QUERIES = {
    "line_stats": line_stats, "chunk_windows": chunk_windows, "chunk_windows_small": chunk_windows_small, "term_counts": term_counts, "doc_freq": doc_freq, "corpus_stats": corpus_stats,
    "bm25_topk": bm25_topk, "bm25_bag_query": bm25_bag_query, "symbol_chunks": symbol_chunks, "chunk_symbols": chunk_symbols, "hybrid_search": hybrid_search,
    "workspace_search": workspace_search, "line_relevance": line_relevance_scores, "compress_keep": compress_keep, "compress_markers": compress_markers,
    "source_classify": source_classify, "glob_filter": glob_filter, "pack_prompts": pack_prompts, "pack_totals": pack_totals, "pack_rendered": prompts,
}

ORACLES = {
    "line_stats": rf"""SELECT project, count(*) AS n_files, sum(len(content) - len(replace(content, chr(10), '')) + 1)::BIGINT AS scan_lines,
  sum(len({_sql_lines('content')}))::BIGINT AS split_lines, sum(octet_length(encode(content)))::BIGINT AS n_bytes FROM sources GROUP BY 1""",
    "chunk_windows": f"WITH {_WINDOWS_SQL} SELECT file_id, window_no::INT AS window_no, start_line, end_line, source_type, md5(content) AS content_md5 FROM win",
    "chunk_windows_small": f"""WITH l AS (SELECT doc_id, {_sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ls, unnest(generate_series(0, greatest(ceil((len(ls) - 8) / 6.0), 0)::INT)) AS window_no FROM l WHERE len(ls) > 0)
SELECT doc_id, window_no::INT AS window_no, (window_no * 6 + 1)::INT AS start_line, (window_no * 6 + len(ls[window_no * 6 + 1 : window_no * 6 + 8]))::INT AS end_line,
  md5(array_to_string(ls[window_no * 6 + 1 : window_no * 6 + 8], chr(10))) AS content_md5 FROM w""",
    "term_counts": f"WITH {_DOCS_SQL}, {_INDEX_SQL} SELECT doc_key, term, tf, dl FROM postings",
    "doc_freq": f"WITH {_DOCS_SQL}, {_INDEX_SQL} SELECT project, term, df FROM term_stats",
    "corpus_stats": f"WITH {_DOCS_SQL}, {_INDEX_SQL} SELECT project, n, round(avg_dl, 6) AS avg_dl FROM sizes",
    "bm25_topk": f"WITH {_DOCS_SQL}, {_INDEX_SQL}, {_bm25_sql(['decode', 'the', 'pending', 'route', 'snapshot'], 20)} SELECT project, doc_key, rank, round(bm25, 6) AS bm25 FROM top",
    "bm25_bag_query": f"WITH {_DOCS_SQL}, {_INDEX_SQL}, {_bm25_sql(['invoice', 'invoice', 'cursor', 'retry', 'budget', 'limit'], 20)} SELECT project, doc_key, rank, round(bm25, 6) AS bm25 FROM top",
    "symbol_chunks": f"WITH {_WINDOWS_SQL}, {_SYMBOLS_SQL} SELECT DISTINCT doc_key, lower(name) AS name_lower FROM win JOIN sy ON sy.project = win.project AND sy.path = win.path AND line BETWEEN start_line AND end_line",
    "chunk_symbols": f"""WITH {_WINDOWS_SQL}, {_SYMBOLS_SQL}, n AS (SELECT s.*, CASE WHEN s.parent_ord IS NULL THEN s.name WHEN p.name IS NULL THEN s.name ELSE p.name || '.' || s.name END AS shown
  FROM sy s LEFT JOIN sy p ON p.project = s.project AND p.path = s.path AND p.ord = s.parent_ord AND p.parent_ord IS NULL)
SELECT doc_key, string_agg(shown, ',' ORDER BY ord, shown) AS symbols FROM win JOIN n ON n.project = win.project AND n.path = win.path AND line BETWEEN start_line AND end_line GROUP BY 1""",
    "hybrid_search": f"WITH {_WINDOWS_SQL}, d AS (SELECT project, doc_key, content FROM win), {_INDEX_SQL}, {_bm25_sql(_HYBRID_WORDS, 30)}, {_SYMBOLS_SQL}, {_NAMES_SQL}, {_FUSE_SQL} SELECT project, doc_key, final_rank, round(score, 6) AS score FROM fr WHERE final_rank <= 10",
    "workspace_search": f"WITH {_WINDOWS_SQL}, d AS (SELECT project, doc_key, content FROM win), {_INDEX_SQL}, {_bm25_sql(_HYBRID_WORDS, 75)}, {_SYMBOLS_SQL}, {_NAMES_SQL}, {_FUSE_SQL} SELECT project, doc_key, round(score, 6) AS score FROM fr WHERE final_rank <= 25 ORDER BY round_even(score, 4) DESC, project, final_rank LIMIT 25",
    "line_relevance": _SCORED_SQL + " SELECT evidence_id, ln, round(relevance, 6) AS relevance FROM sc",
    "compress_keep": _KEPT_SQL + " SELECT evidence_id, ln, keep FROM kept",
    "compress_markers": _MARKERS_SQL,
    "source_classify": r"""SELECT CASE WHEN lower(path) LIKE '%test%' THEN 'test' WHEN regexp_matches(lower(path), '\.(md|rst|txt)$') THEN 'doc'
  WHEN regexp_matches(lower(path), '\.(toml|yaml|yml|json|cfg|ini)$') THEN 'config' ELSE 'code' END AS source_type, count(*) AS n FROM sources GROUP BY 1""",
    "glob_filter": "SELECT file_id FROM sources WHERE (starts_with(path, 'src/') OR path LIKE '%.go') AND path NOT LIKE '%generator%' AND NOT starts_with(path, 'src/core')",
    "pack_prompts": _PACK_SQL,
    "pack_totals": f"WITH {_SLOTS_SQL} SELECT prompt_id, {BUDGET} AS budget, sum(tokens)::BIGINT AS total_before_trim, greatest(sum(tokens) - {BUDGET}, 0)::BIGINT AS over_budget, count(*)::INT AS n_slots FROM sz GROUP BY 1",
}
