import io
import json
import subprocess
import sys

import pytest

from sourceloom import cli, toolserver
from sourceloom.engine import FOLDER, Engine
from sourceloom.operators import spec, traces, verify
from sourceloom.operators.freshness import freshness_warnings
from sourceloom.sources.repo import find_projects, read_tree
from sourceloom.streaming.traces import trace_stream, windowed_summary

SPEC = """id: login
title: "Sign in"
status: approved
backend:
  api:
    - id: a1
      method: POST
      path: /auth/login
    - id: a2
      method: GET
      path: '/auth/{id}'
      body: x
  affected_files:
    - src/gone.py  # 修改
    - src/main.py  # 修改
  testing:
    - POST rejects "bad" input
frontend:
  calls:
    - GET /auth/{user}
    - GET /nowhere
  testing:
    - shows "the" form
"""


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "shop"
    for path, text in {
        "pyproject.toml": 'dependencies = ["fastapi"]\n', "src/main.py": 'from fastapi import APIRouter\n\n@router.get("/auth/{id}")\ndef read_token(id: int):\n    """Validate a token."""\n    return decode(id)\n',
        "src/__init__.py": "", "src/models.py": "class User(BaseModel):\n    name: str\n", "node_modules/x.py": "def no(): pass\n", "bad.py": b"caf\xe9 = 1\n", ".env.example": "A=1\n", "notes.md": "token notes\n",
    }.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def test_source_tree(spark, repo):
    rows = {r["path"]: r for r in read_tree(spark, str(repo)).collect()}
    assert set(rows) == {"pyproject.toml", "src/main.py", "src/__init__.py", "src/models.py", "bad.py", ".env.example", "notes.md"}
    assert rows["bad.py"]["content"] == "caf\ufffd = 1\n" and rows["bad.py"]["n_bytes"] == 9 and rows["bad.py"]["project"] == "shop"
    only = read_tree(spark, str(repo), (".py",), ["src/"], ["src/models*"]).collect()
    assert {r["path"] for r in only} == {"src/main.py", "src/__init__.py"}
    assert {r["path"] for r in read_tree(spark, str(repo), max_bytes=8).collect()} == {"src/__init__.py", ".env.example"}


def test_workspace_discovery(tmp_path):
    assert find_projects(str(tmp_path)) == [str(tmp_path)]
    (tmp_path / "a/.git").mkdir(parents=True)
    assert find_projects(str(tmp_path)) == [str(tmp_path / "a")]
    (tmp_path / "b").mkdir()
    (tmp_path / FOLDER).mkdir()
    (tmp_path / FOLDER / "workspace.yaml").write_text("projects:\n  - name: z\n    path: b\n  - path: c\n")
    assert find_projects(str(tmp_path)) == [str(tmp_path / "b")]


def test_engine(spark, repo):
    e = Engine(spark)
    out = e.init(str(repo))
    assert out["routes"] == 1 and out["models"] == 1 and "routes.txt" in out["files_written"] and out["files"] == 4
    assert "GET /auth/{id}" in (repo / FOLDER / "analysis/routes.txt").read_text()
    (repo / FOLDER / "context/api-contracts.md").write_text("# API\nnothing here\n")
    assert e.context_warnings(str(repo)) == ["Route GET /auth/{id} not mentioned in context/api-contracts.md"]
    assert e.sync(str(repo), diff=True)["written"] == []
    hits = e.search(str(repo), "validate token", 3).collect()
    assert hits[0]["path"] == "src/main.py" and "read_token" in hits[0]["symbols"]
    assert e.search(str(repo), "", 3).count() == 0
    done = e.pipeline("validate token", str(repo), 500)
    assert "<task>\nvalidate token\n</task>" in done["prompt"] and "# API" in done["prompt"] and "### src/main.py" in done["prompt"]
    assert e.pipeline("qqqq", str(repo)) is None
    assert e.run_summary(str(repo))["total_runs"] == 1


def test_specs(spark, repo):
    folder = repo / FOLDER / "specs"
    folder.mkdir(parents=True)
    (folder / "login.yaml").write_text(SPEC)
    (folder / "other.yml").write_text("title: O\n  status: approved\n")
    e = Engine(spark)
    specs = e.specs(str(repo))
    assert {(r["id"], r["title"], r["status"]) for r in spec.list_specs(specs).collect()} == {("login", "Sign in", "approved"), ("other", "O", "")}
    assert spec.show_spec(specs, "log").first()["spec_id"] == "login" and spec.show_spec(specs, "zz").count() == 0
    chosen = specs.where("spec_id = 'login'")
    table = spec.sections(chosen)
    apis = {(r["section"], r["method"], r["path"], r["has_body"]) for r in spec.spec_apis(chosen, table).collect()}
    assert apis == {("backend", "POST", "/auth/login", False), ("backend", "GET", "/auth/{id}", True), ("frontend", "GET", "/auth/{user}", False), ("frontend", "GET", "/nowhere", False)}
    issues = spec.validate_specs(chosen, None, read_tree(spark, str(repo)))
    assert {r["message"] for r in issues.collect()} == {"POST /auth/login has no request body fields defined", "[frontend] calls /nowhere but no backend has a matching route", "File to modify not found: src/gone.py"}
    assert spec.validation_report(chosen, issues).first()["report"].startswith("Spec login: 1 error(s), 2 warning(s)")
    lacking = {r["message"] for r in spec.validate_specs(specs.where("spec_id = 'other'")).collect()}
    assert lacking == {"Missing required field: id", "Missing required field: status", "No testing section found in spec"}
    code = {r["filename"]: r["code"] for r in spec.test_skeletons(chosen).collect()}
    assert "def test_post_rejects_bad_input():" in code["test_login_backend.py"] and "# API: POST /auth/login" in code["test_login_backend.py"]
    assert 'it("shows \\"the\\" form"' in code["test_login_frontend.ts"]
    assert e.set_spec_status(str(repo), "log", "done") and "status: done\n" in (folder / "login.yaml").read_text() and not e.set_spec_status(str(repo), "other", "x")
    named = spec.workspace_projects(spark, "- name: web\n  language: python\n  framework: Vue\n- name: api\n  language: go\n")
    assert {(r["name"], r["type"]) for r in named.collect()} == {("web", "frontend"), ("api", "backend")}


def test_traces(spark, tmp_path):
    good = {"task": "t", "chunks_total_tokens": 100, "compressed_tokens": 50, "total_input_tokens": 10, "packed_tokens": 4, "total_time_s": 0.5}
    (tmp_path / "pipeline-2026-01-02.jsonl").write_text("\n".join([json.dumps(good), "", json.dumps(good), "{bad", json.dumps(good)]))
    (tmp_path / "pipeline-2026-01-01.jsonl").write_text("\n".join([json.dumps(good)] * 60 + [json.dumps(good | {"what": 1})]))
    (tmp_path / "pipeline-2025-12-31.jsonl").write_text(json.dumps(good))
    assert traces.load_traces(spark, str(tmp_path)).count() == 63
    (tmp_path / "pipeline-2026-01-03.jsonl").write_text("\n".join([json.dumps(good)] * 50))
    assert traces.load_traces(spark, str(tmp_path), 1).count() == 50
    r = traces.summarise(traces.load_traces(spark, str(tmp_path), 1)).first()
    assert (r["total_runs"], r["avg_compression_ratio"], r["total_tokens_saved"], r["avg_packed_tokens"]) == (50, 0.5, 300, 4)
    none = traces.summarise(spark.createDataFrame([], traces.TRACE)).first()
    assert none["total_runs"] == 0 and none["avg_compression_ratio"] == 0.0


def test_trace_stream(spark, tmp_path):
    rows = [{"timestamp": f"2026-01-01T0{h}:10:00", "compressed_tokens": h, "chunks_total_tokens": 10, "total_input_tokens": 5, "packed_tokens": 2, "total_time_s": 1.0} for h in (1, 1, 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = windowed_summary(trace_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["total_runs"] for r in spark.table("sums").collect()) == [1, 2]


def test_checks(spark, tmp_path):
    rows = verify.run_checks(spark, str(tmp_path), checks=[("custom", [sys.executable, "-c", "print(1)"]), ("test", [sys.executable, "-c", "print('1 failed'); exit(1)"]), ("lint", ["no-such-command-x"])])
    got = [(r["kind"], r["passed"], r["summary"]) for r in rows.collect()]
    assert got == [("custom", True, "Passed"), ("test", False, "1 failed"), ("lint", False, "Command not found: no-such-command-x")]
    assert verify.roll_up(rows).first().asDict() == {"passed": False, "n_checks": 3, "n_failed": 2}
    assert verify.roll_up(spark.createDataFrame([], verify.CHECKS)).first()["passed"] is True
    assert verify.run_check(str(tmp_path), "test", [sys.executable, "-c", "import time; time.sleep(9)"], 1)[6] == "Timed out after 1s"
    said = verify.feedback([r.asDict() for r in rows.collect()], 60)
    assert said.startswith("## Verification Failures") and said.endswith("... [more failures omitted]")
    assert verify.check_summary("lint", False, "a error\nb warning", "") == "2 issue(s) found. First: a error"
    (tmp_path / "go.mod").write_text("")
    assert verify.resolve_checks(str(tmp_path)) == [("test", ["go", "test", "./..."])]


def test_freshness(spark):
    context = spark.createDataFrame([("p", "api-contracts.md", "x /a y"), ("p", "modules.md", "# T\n<!-- c -->"), ("p", "data-models.md", "User")], "project string, name string, content string")
    routes = spark.createDataFrame([("p", "GET", "/a"), ("p", "GET", "/b")], "project string, method string, path string")
    models = spark.createDataFrame([("p", "User"), ("p", "Order")], "project string, name string")
    files = spark.createDataFrame([("p", "src/a.py")], "project string, path string")
    assert [r["text"] for r in freshness_warnings(routes, files, models, context).orderBy("part").collect()] == ["Route GET /b not mentioned in context/api-contracts.md", "Model 'Order' not mentioned in context/data-models.md"]


def test_cli_and_tools(spark, repo, capsys):
    e = Engine(spark)
    assert cli.run(e, cli._parser().parse_args(["scan", "--repo", str(repo)])) == 0
    assert "## src/main.py" in capsys.readouterr().out
    assert cli.run(e, cli._parser().parse_args(["search", "--repo", str(repo), "token"])) == 0
    assert "src/main.py" in capsys.readouterr().out
    assert cli.run(e, cli._parser().parse_args(["spec", "--repo", str(repo), "show", "x"])) == 1
    assert cli.run(e, cli._parser().parse_args(["verify", "--repo", str(repo), "--run", f"{sys.executable} -c exit(1)"])) == 1
    out = io.StringIO()
    asked = [{"id": 1, "method": "initialize"}, {"method": "note"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"repo": str(repo), "query": "token"}}}, {"id": 4, "method": "nope"}, {"id": 5, "method": "tools/call", "params": {"name": "search", "arguments": {}}}]
    toolserver.serve(e, io.StringIO("\n".join(map(json.dumps, asked)) + "\n\n{"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert said[0]["result"]["serverInfo"]["name"] == "sourceloom" and len(said[1]["result"]["tools"]) == 4 and "src/main.py" in said[2]["result"]["content"][0]["text"]
    assert said[3]["error"]["code"] == -32601 and said[4]["result"]["isError"] and said[5]["error"]["code"] == -32700


def test_entry_without_llm():
    code = "import sys; sys.modules['sourceloom.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('p') and q[1:2].isdigit() and not q.startswith('p1_')]; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parent.parent)).returncode == 0
