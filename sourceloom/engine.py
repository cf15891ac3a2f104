"""One object for all: scan, analyse, search, compress, pack, check.

Projects are folders or tables (project, path, content). Everything up to the
final text is a plan; only top-k rows and rendered views reach the driver.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.extract.analysis import Analysis, run_analysis
from sourceloom.extract.symbols import imports_of, scan_files, symbols_of
from sourceloom.functions.text import is_template, is_unfilled, path_filter, rough_tokens, walk_key
from sourceloom.operators import mapviews, spec, traces
from sourceloom.operators.chunking import line_windows
from sourceloom.operators.compress import compress
from sourceloom.operators.freshness import freshness_warnings
from sourceloom.operators.index import query_index, symbol_windows, window_symbols
from sourceloom.operators.rank import search as rank_search
from sourceloom.operators.rank import search_workspace
from sourceloom.operators.slots import greedy_pack, pack_stats, render_prompt, with_presets
from sourceloom.operators.verify import context_row, run_checks
from sourceloom.sources.repo import INDEX_EXTENSIONS, SCAN_IGNORED, SYMBOL_EXTENSIONS, find_projects, read_tree

#: The folder in a project or workspace that holds what this library writes.
FOLDER = ".sourceloom"

#: Context files that a new project gets, each a template until it is filled.
TEMPLATES = {
    "api-contracts.md": "# API contracts\n\n<!-- What does each route promise to its callers? -->\n",
    "modules.md": "# Modules\n\n<!-- What is each top directory for? -->\n",
    "data-models.md": "# Data models\n\n<!-- What do the models mean, beyond their fields? -->\n",
    "conventions.md": "# Conventions\n\n<!-- Which rules does the code follow? -->\n",
}

#: Object tables and the files that show them, with the columns that order them.
VIEWS = {
    "routes": ("routes.txt", ["file", "line"]), "models": ("models.txt", ["file", "line"]), "pages": ("pages.txt", ["component_file", "line"]), "components": ("components.txt", ["file", "line"]),
    "stores": ("stores.txt", ["file", "line"]), "api_calls": ("api-calls.txt", ["file", "line"]), "infra": ("infrastructure.txt", ["name"]), "env_vars": ("env-vars.txt", ["name"]),
}


class Scan:
    """Files, symbols and imports of one or more projects."""

    def __init__(self, files: DataFrame):
        self.source = files
        self.files, self.symbols, self.imports = scan_files(files).persist(), symbols_of(files).persist(), imports_of(files).persist()

    def text(self, max_depth: int = 2) -> str:
        return "\n\n".join(r["text"] for r in mapviews.full_map(self.files, self.symbols, self.imports, max_depth).orderBy("project").collect())

    def focused_text(self, focus: DataFrame, max_depth: int = 2, show_others: bool = True) -> str:
        return "\n\n".join(r["text"] for r in mapviews.focused_map(self.files, self.symbols, self.imports, focus, max_depth, show_others).orderBy("project").collect())

    def json(self) -> list[dict]:
        return [json.loads(r["json"]) for r in mapviews.map_json(self.files, self.symbols, self.imports).collect()]

    def totals(self) -> dict:
        r = mapviews.scan_totals(self.files, self.symbols, self.imports).agg(F.sum("n_files"), F.sum("n_symbols"), F.sum("n_imports")).first()
        return {"files": r[0] or 0, "symbols": r[1] or 0, "imports": r[2] or 0}


class Engine:
    """Works on folders; every method may also be given a table of files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    # reading

    def scan(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Scan:
        """The symbol map of a project."""
        return Scan(read_tree(self.spark, root, SYMBOL_EXTENSIONS, include, exclude))

    def analyse(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Analysis:
        """Framework objects of a project; marker files are read as well."""
        files = read_tree(self.spark, root, ignored=tuple(d for d in SCAN_IGNORED if d not in ("env", "vendor")))
        root_level = ~F.contains("path", F.lit("/"))
        return run_analysis(files.where(path_filter(F.col("path"), include, exclude) | root_level))

    def windows(self, roots: str | list[str], exclude: list[str] | None = None, size: int = 40, overlap: int = 10) -> DataFrame:
        """The line windows of one or more projects, with a key that orders
        them as a walk does."""
        files = read_tree(self.spark, roots, INDEX_EXTENSIONS, None, exclude)
        return line_windows(files, size, overlap).withColumn("doc_key", F.struct(walk_key(F.col("path")).alias("w"), F.col("window_no").alias("n")))

    # search

    def search(self, roots: str | list[str], query: str, top_k: int = 10, exclude: list[str] | None = None) -> DataFrame:
        """Ranked windows: project, path, source_type, start_line, end_line,
        content, symbols, score, final_rank. Of several projects the best over
        all, each with its own statistics."""
        files = read_tree(self.spark, roots, INDEX_EXTENSIONS, None, exclude)
        return self.search_files(files, query, top_k, workspace=not isinstance(roots, str))

    def search_files(self, files: DataFrame, query: str, top_k: int = 10, workspace: bool = False) -> DataFrame:
        """search() on a table of files."""
        windows = line_windows(files).withColumn("doc_key", F.struct(walk_key(F.col("path")).alias("w"), F.col("window_no").alias("n")))
        symbols = symbols_of(files)
        index = query_index(windows, query)
        hits = symbol_windows(windows, symbols)
        ranked = (search_workspace if workspace else rank_search)(index, hits, query, top_k)
        named = window_symbols(windows, symbols)
        out = F.broadcast(ranked.select("project", "doc_key", "score", "final_rank")).join(windows, ["project", "doc_key"]).join(named, ["project", "doc_key"], "left")
        return out.select("project", "path", "source_type", "start_line", "end_line", "content", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "score", "final_rank").orderBy(F.desc("score"), "project", "final_rank")

    # prompts

    def context_slots(self, root: str) -> dict[str, str]:
        """The slots project_context and spec from a project's folder, or from
        all projects of a workspace."""
        top = Path(root).resolve()
        folders = []
        specs: list[str] = []
        if (top / FOLDER / "workspace.yaml").exists():
            folders = [(p.name, p / FOLDER) for p in sorted(top.iterdir()) if (p / FOLDER).is_dir()]
            specs += self._active_specs(top / FOLDER / "specs")
        elif (top / FOLDER).is_dir():
            folders = [(top.name, top / FOLDER)]
        parts: list[str] = []
        for name, folder in folders:
            parts += self._context_parts(folder, f"[{name}] " if len(folders) > 1 else "")
            specs += self._active_specs(folder / "specs")
        return {k: "\n\n".join(v) for k, v in (("project_context", parts), ("spec", specs)) if v}

    def _context_parts(self, folder: Path, prefix: str) -> list[str]:
        listed = []
        if (folder / "config.yaml").exists():
            rows = [x.strip() for x in (folder / "config.yaml").read_text().splitlines()]
            listed = [x.split("context/")[-1] for x in rows if x.startswith("- context/") and x.endswith(".md")]
        context = folder / "context"
        if not context.is_dir():
            return []
        names = listed or sorted(p.name for p in context.iterdir() if p.suffix == ".md")
        rows = [(k, n, (context / n).read_text(errors="replace").strip()) for k, n in enumerate(names) if (context / n).exists()]
        if not rows:
            return []
        df = self.spark.createDataFrame(rows, "k int, name string, content string")
        kept = df.where((F.col("content") != "") & ~is_unfilled(F.col("content"))).orderBy("k").collect()
        return [f"## {prefix}{r['name']}\n\n{r['content']}" for r in kept]

    def specs(self, root: str) -> DataFrame:
        """(spec_id, file, content) of a folder's specifications, or of its
        parent's."""
        for base in (Path(root).resolve(), Path(root).resolve().parent):
            folder = base / FOLDER / "specs"
            if folder.is_dir():
                rows = [(p.stem, f"{FOLDER}/specs/{p.name}", p.read_text(errors="replace")) for p in sorted(folder.iterdir()) if p.suffix in (".yaml", ".yml")]
                return self.spark.createDataFrame(rows, "spec_id string, file string, content string")
        return self.spark.createDataFrame([], "spec_id string, file string, content string")

    def _active_specs(self, folder: Path) -> list[str]:
        if not folder.is_dir():
            return []
        rows = [(p.stem, p.read_text(errors="replace")) for p in sorted(folder.iterdir()) if p.suffix in (".yaml", ".yml")]
        if not rows:
            return []
        df = self.spark.createDataFrame(rows, "spec_id string, content string").where(spec.is_active(F.col("content")))
        return [f"## Spec: {r['spec_id']}\n\n```yaml\n{r['content']}\n```" for r in df.orderBy("spec_id").collect()]

    def pack(self, slots: dict[str, str], budget: int = 8000) -> tuple[str, dict]:
        """A prompt from named slots within a budget, and its statistics."""
        rows = [("p", n, c, None, k) for k, (n, c) in enumerate(slots.items())]
        df = with_presets(self.spark.createDataFrame(rows, "prompt_id string, name string, content string, priority int, insert_ord int"))
        prompt = render_prompt(greedy_pack(df, budget)).first()
        stats = pack_stats(df, budget).first()
        return (prompt["prompt"] if prompt else ""), (stats.asDict(True) if stats else {"budget": budget, "total_before_trim": 0, "over_budget": 0, "slots": {}})

    def pipeline(self, task: str, root: str, budget: int = 8000, top_k: int = 10, record: bool = True, context: bool = True) -> dict | None:
        """Retrieves, compresses, maps and packs for a task; None (and no
        record) if nothing is found."""
        began = time.monotonic()
        roots = find_projects(root, FOLDER)
        found = self.search(roots if len(roots) > 1 else roots[0], task, top_k)
        chunks = found.collect()
        searched = time.monotonic()
        if not chunks:
            return None
        several = len(roots) > 1
        rows = [(k, f"{r['project']}:{r['path']}" if several else r["path"], r["start_line"], r["end_line"], ", ".join(r["symbols"]), r["content"], r["project"], r["path"]) for k, r in enumerate(chunks)]
        df = self.spark.createDataFrame(rows, "k int, uri string, start_line int, end_line int, symbols string, content string, project string, path string")
        packed = {r["k"]: r["compressed"] for r in compress(df, task, ["k"]).collect()}
        evidence = "\n\n".join(f"# {r[1]}  L{r[2]}-{r[3]}{f'  ({r[4]})' if r[4] else ''}\n{packed.get(r[0], r[5])}" for r in rows)
        compressed = time.monotonic()
        scan = Scan(read_tree(self.spark, roots, SYMBOL_EXTENSIONS))
        slots = {**(self.context_slots(root) if context else {}), "task": task, "repo_map": scan.focused_text(df.select("project", "path").distinct(), show_others=False), "evidence": evidence}
        prompt, stats = self.pack(slots, budget)
        ended = time.monotonic()
        sizes = self.spark.createDataFrame([(c[5], packed.get(c[0], c[5])) for c in rows], "a string, b string").agg(F.sum(rough_tokens(F.col("a"))), F.sum(rough_tokens(F.col("b")))).first()
        used = self.spark.createDataFrame([(prompt,)], "t string").select(rough_tokens(F.col("t"))).first()[0]
        token = lambda n: int(stats["slots"].get(n, {}).get("tokens", 0))
        trace = {
            "timestamp": datetime.now().isoformat(), "task": task, "repo": os.path.basename(os.path.abspath(root)), "chunks_retrieved": len(rows), "chunks_total_tokens": sizes[0], "chunks_after_compression": len(rows),
            "compressed_tokens": sizes[1], "compression_ratio": sizes[1] / sizes[0] if sizes[0] else 0.0, "project_context_tokens": token("project_context"), "spec_tokens": token("spec"), "repo_map_tokens": token("repo_map"),
            "total_input_tokens": int(stats["total_before_trim"]), "packed_tokens": used, "token_budget": budget, "over_budget": int(stats["over_budget"]), "index_time_s": 0.0, "search_time_s": searched - began,
            "compress_time_s": compressed - searched, "pack_time_s": ended - compressed, "total_time_s": ended - began,
        }
        if record:
            self.record(root, trace)
        return {"prompt": prompt, "stats": stats, "trace": trace}

    # records

    def record(self, root: str, trace: dict) -> Path:
        """Appends a trace to the file of its day."""
        folder = Path(root).resolve() / FOLDER / "telemetry"
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"pipeline-{trace['timestamp'][:10]}.jsonl"
        with path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(trace, ensure_ascii=False) + "\n")
        return path

    def run_summary(self, root: str, days: int = 7) -> dict:
        """Totals of the recorded runs of a project, or of its parent's."""
        for base in (Path(root).resolve(), Path(root).resolve().parent):
            folder = base / FOLDER / "telemetry"
            if folder.is_dir() and any(folder.glob("pipeline-*.jsonl")):
                r = traces.summarise(traces.load_traces(self.spark, str(folder), days)).first().asDict()
                return r if r["total_runs"] else {"total_runs": 0}
        return {"total_runs": 0}

    # projects

    def _views(self, root: str, include=None, exclude=None) -> tuple[Analysis, Scan, dict[str, str]]:
        analysis, scan = self.analyse(root, include, exclude), self.scan(root, include, exclude)
        out = {"repo-map.txt": scan.text()}
        modules = mapviews.modules_text(scan.files, scan.symbols).first()
        out["modules.txt"] = modules["text"] if modules else "# Module Structure\n"
        tables = {**analysis.tables, "infra": analysis.infra, "env_vars": analysis.env_vars}
        for name, (file, order) in VIEWS.items():
            row = mapviews.render_objects(tables[name], name, order).first()
            if row:
                out[file] = row["text"]
        return analysis, scan, out

    def init(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> dict:
        """Writes a project's views, templates that are missing and a
        configuration; gives counts and warnings."""
        top = Path(root).resolve()
        analysis, scan, views = self._views(root, include, exclude)
        deps = mapviews.dependencies_text(read_tree(self.spark, root, ignored=SCAN_IGNORED).where(~F.contains("path", F.lit("/")))).first()
        if deps:
            views["dependencies.txt"] = deps["text"]
        for part in ("analysis", "context", "specs", "telemetry"):
            (top / FOLDER / part).mkdir(parents=True, exist_ok=True)
        self._write(top, views)
        for name, text in TEMPLATES.items():
            if not (top / FOLDER / "context" / name).exists():
                (top / FOLDER / "context" / name).write_text(text)
        kind = analysis.projects.first()
        listed = "".join(f"  - context/{n}\n" for n in TEMPLATES)
        lists = "".join(f"  {k}: [{', '.join(v)}]\n" for k, v in (("include", include or []), ("exclude", exclude or [])))
        (top / FOLDER / "config.yaml").write_text(f"project: {top.name}\nlanguage: {kind['language'] if kind else 'unknown'}\nframework: {kind['framework'] if kind else ''}\ntype: {kind['project_type'] if kind else 'backend'}\nscan:\n{lists}context:\n{listed}")
        if not (top / FOLDER / ".gitignore").exists():
            (top / FOLDER / ".gitignore").write_text("telemetry/\n")
        return {**scan.totals(), **self._counts(analysis), "files_written": sorted(views), "warnings": [r["text"] for r in analysis.warnings.orderBy("ord").collect()]}

    def _counts(self, analysis: Analysis) -> dict[str, int]:
        """Rows of each object table, in one job."""
        every = None
        for name, rows in analysis.tables.items():
            part = rows.select(F.lit(name).alias("name"))
            every = part if every is None else every.unionByName(part)
        found = {r["name"]: r["count"] for r in every.groupBy("name").count().collect()}
        return {name: found.get(name, 0) for name in analysis.tables}

    def _write(self, top: Path, views: dict[str, str]) -> list[str]:
        folder = top / FOLDER / "analysis"
        folder.mkdir(parents=True, exist_ok=True)
        changed = [n for n, t in views.items() if not (folder / n).exists() or (folder / n).read_text() != t]
        for name, text in views.items():
            (folder / name).write_text(text)
        return sorted(changed)

    def scan_filters(self, root: str) -> tuple[list[str], list[str]]:
        """include and exclude of a project's configuration: bracketed lists on
        one line."""
        path = Path(root).resolve() / FOLDER / "config.yaml"
        found: dict[str, list[str]] = {"include": [], "exclude": []}
        for line in path.read_text().splitlines() if path.exists() else []:
            key, _, value = line.strip().partition(":")
            if key in found and value.strip().startswith("[") and value.strip().endswith("]"):
                found[key] = [x.strip().strip("'\"") for x in value.strip()[1:-1].split(",") if x.strip()]
        return found["include"], found["exclude"]

    def context_files(self, root: str) -> DataFrame:
        """(project, name, content) of a project's context files."""
        top = Path(root).resolve()
        folder = top / FOLDER / "context"
        rows = [(top.name, p.name, p.read_text(errors="replace")) for p in sorted(folder.glob("*.md"))] if folder.is_dir() else []
        return self.spark.createDataFrame(rows, "project string, name string, content string")

    def context_warnings(self, root: str) -> list[str]:
        """What the written context doesn't mention any more."""
        include, exclude = self.scan_filters(root)
        return self._stale(root, self.analyse(root, include, exclude), self.scan(root, include, exclude))

    def _stale(self, root: str, analysis: Analysis, scan: Scan) -> list[str]:
        found = freshness_warnings(analysis.tables["routes"], scan.files, analysis.tables["models"], self.context_files(root))
        return [r["text"] for r in found.orderBy("part", "text").collect()]

    def sync(self, root: str, check_only: bool = False, diff: bool = False) -> dict:
        """Refreshes the views. check_only writes nothing; diff tells what
        changed instead of what is stale. Views whose objects have all gone
        stay as they were."""
        if check_only:
            return {"warnings": self.context_warnings(root), "written": []}
        analysis, scan, views = self._views(root, *self.scan_filters(root))
        warnings = [] if diff else self._stale(root, analysis, scan)
        changed = self._write(Path(root).resolve(), views)
        return {**scan.totals(), "written": changed, "warnings": [f"changed: {n}" for n in changed] if diff else warnings}

    def init_workspace(self, root: str) -> dict:
        """Initialises every project of a workspace and lists them in one
        file."""
        top = Path(root).resolve()
        stats, entries = {}, []
        for project in find_projects(root, FOLDER):
            stats[os.path.basename(project)] = self.init(project)
            kind = self.analyse(project).projects.first()
            entries.append(f"  - name: {os.path.basename(project)}\n    path: {os.path.relpath(project, top)}\n    language: {kind['language'] if kind else 'unknown'}\n    framework: {kind['framework'] if kind else ''}\n")
        (top / FOLDER / "specs").mkdir(parents=True, exist_ok=True)
        (top / FOLDER / "workspace.yaml").write_text("projects:\n" + "".join(entries))
        return stats

    def projects(self, root: str) -> DataFrame:
        """(name, type) of the projects that a workspace file lists."""
        for base in (Path(root).resolve(), Path(root).resolve().parent):
            path = base / FOLDER / "workspace.yaml"
            if path.exists():
                return spec.workspace_projects(self.spark, path.read_text())
        return spec.workspace_projects(self.spark, "")

    def set_spec_status(self, root: str, spec_id: str, status: str) -> bool:
        """Rewrites the status of the first specification, by name, whose stem
        is or contains the id."""
        for base in (Path(root).resolve(), Path(root).resolve().parent):
            folder = base / FOLDER / "specs"
            for path in sorted(folder.iterdir()) if folder.is_dir() else []:
                if path.stem == spec_id or path.name == spec_id or spec_id in path.stem:
                    row = self.spark.createDataFrame([(path.read_text(),)], "t string").select(spec.with_status(F.col("t"), status)).first()
                    if row[0] is None:
                        return False
                    path.write_text(row[0])
                    return True
        return False

    def verify(self, root: str, kinds: set[str] | None = None, checks: list[tuple[str, list[str]]] | None = None, timeout: int = 120) -> DataFrame:
        """Runs a project's checks on the driver and the freshness check."""
        out = run_checks(self.spark, root, kinds, checks, timeout)
        if (kinds is None or "context" in kinds) and (Path(root).resolve() / FOLDER / "context").is_dir():
            began = time.monotonic()
            out = out.unionByName(self.spark.createDataFrame([context_row(self.context_warnings(root), time.monotonic() - began)], out.schema))
        return out

    def unfilled_context(self, root: str) -> list[str]:
        """Context files that are still templates."""
        return [r["name"] for r in self.context_files(root).where(is_template(F.col("content"))).collect()]
