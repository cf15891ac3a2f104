"""Command line: scan, search, pack, pipeline, init, sync, spec, context,
verify, summary and serve."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sourceloom.engine import FOLDER, Engine
from sourceloom.operators import spec
from sourceloom.operators.verify import feedback, roll_up
from sourceloom.sources.repo import find_projects


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sourceloom")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags, **options):
        s = sub.add_parser(name)
        s.add_argument("--repo", default=".")
        for f in flags:
            s.add_argument(f, action="store_true")
        for key, kind in options.items():
            s.add_argument("--" + key.replace("_", "-"), **kind)
        return s

    lists = {"include": {"action": "append"}, "exclude": {"action": "append"}}
    add("scan", "--json", depth={"type": int, "default": 2}, **lists)
    add("search", "--json", top_k={"type": int, "default": 10}).add_argument("query")
    add("pack", "--stats", budget={"type": int, "default": 8000}).add_argument("slots", nargs="+", metavar="NAME=PATH")
    add("pipeline", "--stats", budget={"type": int, "default": 8000}, top_k={"type": int, "default": 10}).add_argument("task")
    add("init", **lists)
    add("sync", "--check", "--diff")
    s = add("spec", "--json")
    s.add_argument("action", choices=["list", "show", "status", "validate", "test"])
    s.add_argument("values", nargs="*")
    s = add("context")
    s.add_argument("action", choices=["list", "show"])
    s.add_argument("name", nargs="?")
    add("verify", "--json", kind={"action": "append"}, run={"action": "append"}, timeout={"type": int, "default": 120})
    add("summary", days={"type": int, "default": 7})
    sub.add_parser("serve")
    return p


def _spec(engine: Engine, a) -> int:
    specs = engine.specs(a.repo)
    if a.action == "list":
        for r in spec.list_specs(specs).orderBy("file").collect():
            print(json.dumps(r.asDict()) if a.json else f"{r['id']}  [{r['status']}]  {r['title']}")
        return 0
    chosen = spec.show_spec(specs, a.values[0]) if a.values else specs.limit(0)
    row = chosen.first()
    if row is None:
        print("no such specification", file=sys.stderr)
        return 1
    if a.action == "show":
        print(row["content"])
    elif a.action == "status":
        return 0 if len(a.values) > 1 and engine.set_spec_status(a.repo, *a.values[:2]) else 1
    elif a.action == "validate":
        issues = spec.validate_specs(chosen, engine.projects(a.repo), engine.scan(a.repo).source)
        print(spec.validation_report(chosen, issues).first()["report"])
        return 0 if spec.validation_summary(chosen, issues).first()["passed"] else 1
    else:
        for r in spec.test_skeletons(chosen, engine.projects(a.repo)).orderBy("filename").collect():
            Path(r["filename"]).write_text(r["code"])
            print(r["filename"])
    return 0


def run(engine: Engine, a) -> int:
    """Runs one parsed command; the exit code."""
    if a.command == "scan":
        scan = engine.scan(a.repo, a.include, a.exclude)
        print(json.dumps(scan.json()) if a.json else scan.text(a.depth))
        print(json.dumps(scan.totals()), file=sys.stderr)
    elif a.command == "search":
        roots = find_projects(a.repo, FOLDER)
        rows = engine.search(roots if len(roots) > 1 else roots[0], a.query, a.top_k).collect()
        for r in rows:
            print(json.dumps(r.asDict()) if a.json else f"{r['score']:.3f}  {r['path']}  L{r['start_line']}-{r['end_line']}  {', '.join(r['symbols'][:5])}")
    elif a.command == "pack":
        pairs = [x.partition("=") for x in a.slots]
        prompt, stats = engine.pack({n: sys.stdin.read() if p == "-" else Path(p).read_text() for n, _, p in pairs}, a.budget)
        print(json.dumps(stats) if a.stats else prompt)
    elif a.command == "pipeline":
        out = engine.pipeline(a.task, a.repo, a.budget, a.top_k)
        print("nothing found" if out is None else json.dumps(out["trace"]) if a.stats else out["prompt"])
    elif a.command == "init":
        several = len(find_projects(a.repo, FOLDER)) > 1
        stats = engine.init_workspace(a.repo) if several else engine.init(a.repo, a.include, a.exclude)
        print(json.dumps(stats))
        for s in stats.values() if several else [stats]:
            for w in s["warnings"]:
                print("WARNING", w, file=sys.stderr)
    elif a.command == "sync":
        print(json.dumps(engine.sync(a.repo, a.check, a.diff)))
    elif a.command == "spec":
        return _spec(engine, a)
    elif a.command == "context":
        folder = Path(a.repo).resolve() / FOLDER / "context"
        if a.action == "list":
            for p in sorted(folder.iterdir()) if folder.is_dir() else []:
                if not p.name.startswith("."):
                    print(f"{p.name}  {p.stat().st_size}")
        else:
            path = folder / (a.name or "")
            path = path if path.is_file() else folder / f"{a.name}.md"
            if not path.is_file():
                return 1
            print(path.read_text())
    elif a.command == "verify":
        checks = [("custom", c.split()) for c in a.run] if a.run else None
        result = engine.verify(a.repo, set(a.kind) if a.kind else None, checks, a.timeout)
        rows = result.collect()
        print(json.dumps([r.asDict() for r in rows]) if a.json else feedback(rows))
        return 0 if a.json or roll_up(result).first()["passed"] else 1
    elif a.command == "summary":
        print(json.dumps(engine.run_summary(a.repo, a.days)))
    elif a.command == "serve":
        from sourceloom.toolserver import serve

        serve(engine)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return run(Engine(spark), a)


if __name__ == "__main__":
    sys.exit(main())
