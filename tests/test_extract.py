from pyspark.sql import functions as F

from sourceloom.extract import frameworks as fw
from sourceloom.extract.analysis import parse_env, run_analysis
from sourceloom.extract.symbols import found_in, imports_of, scan_files, symbols_of
from sourceloom.operators.mapviews import dependencies_text, focused_map, full_map, map_json, module_rollup, render_objects, scan_totals

FILES = "project string, path string, content string"


def files(spark, **named):
    return spark.createDataFrame([("p", k.replace("__", "/").replace("_dot_", "."), v) for k, v in named.items()], FILES)


def table(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], FILES)


PY = '''import os, sys
from a.b import (c, d)

@router.get("/items/{id}")
@cached
async def read(id: int, q: str = None, dep=Depends(x), *args) -> dict:
    return {}


class Item(BaseModel):
    name: str
    tag: Optional[str] = None
    _hidden: int = 0

    def size(self, deep: bool = False) -> int:
        return 1

@dataclass
class Hidden:
    x: int
'''


def test_python_symbols():
    symbols, imports = found_in("a.py", PY)
    assert [(s[0], s[1], s[2], s[3]) for s in symbols] == [("read", "function", 6, "def read(id: int, q: str = None, dep=Depends(x), *args) -> dict"), ("Item", "class", 10, "class Item(BaseModel)")]
    assert [(c[0], c[1], c[2], c[3]) for c in symbols[1][4]] == [("size", "method", 15, "def size(self, deep: bool = False) -> int")]
    assert imports == [("os", [], 1), ("sys", [], 1), ("a.b", ["(c", "d)"], 2)]
    broken, _ = found_in("a.py", "def f(x):\n    return (\n\nclass A:\n    def g(self):\n        pass\n")
    assert [s[0] for s in broken] == ["f", "A"] and broken[1][4][0][0] == "g"


def test_other_symbols():
    js, imports = found_in("a.ts", "import { a, b } from 'm';\nimport 'side';\nexport function f(x: number): void {}\nfunction g() {}\nclass C extends D {\n  async m(a) { if (a) { return f(a); } }\n  get p() { return 1; }\n}\nexport class E {}\nconst h = async (q) => q;\nconst k = 1;\n")
    assert [(s[0], s[3]) for s in js] == [("f", "function f(x: number)"), ("g", "function g()"), ("C", "class C"), ("h", "const h = (q) =>")]
    assert [c[0] for c in js[2][4]] == ["m", "p"] and [(i[0], i[1]) for i in imports] == [("m", ["a", "b"]), ("side", [])]
    go, imports = found_in("a.go", 'package p\nimport (\n\t"fmt"\n\tx "y/z"\n)\ntype S struct {\n\ta int\n}\nfunc (s *S) M(a int) error { return nil }\nfunc F() {}\ntype I interface{}\n')
    assert [(s[0], s[1], s[3]) for s in go] == [("S", "struct", "type S struct"), ("M", "method", "func (s *S) M(a int)"), ("F", "function", "func F()"), ("I", "interface", "type I interface")]
    assert [i[0] for i in imports] == ["fmt", "y/z"]
    rs, imports = found_in("a.rs", "use std::io;\npub struct P { x: u8 }\nimpl<T> Tr for P<T> {\n    pub fn m(&self) -> u8 { 1 }\n}\npub fn f(a: u8) -> Result<(), E> { Ok(()) }\n")
    assert [(s[0], s[1], s[3]) for s in rs] == [("P", "struct", "struct P"), ("m", "method", "impl P<T> :: fn m(&self)"), ("f", "function", "fn f(a: u8) -> Result<(), E>")]
    assert imports[0][0] == "std::io"
    java, imports = found_in("A.java", "package p;\nimport java.util.List;\npublic class A {\n  A() {}\n  public List<String> m(int a) { return n(a); }\n  private void n() {}\n}\ninterface I { void x(); }\n")
    assert [(s[0], s[3]) for s in java] == [("A", "class A")] and [c[3] for c in java[0][4]] == ["List<String> m(int a)", "void n()"] and imports[0][0] == "java.util.List"
    assert found_in("a.kt", "fun f() {}") == ([], [])


def test_scan_views(spark):
    f = table(spark, [("a.py", PY), ("src/b.go", "package b\nfunc F() {}\n"), ("notes.md", "# x")])
    files_, symbols, imports = scan_files(f), symbols_of(f), imports_of(f)
    assert {(r["path"], r["lines"]) for r in files_.collect()} == {("a.py", PY.count("\n") + 1), ("src/b.go", 3)}
    assert scan_totals(files_, symbols, imports).first().asDict() == {"project": "p", "n_files": 2, "n_symbols": 4, "n_imports": 3}
    text = full_map(files_, symbols, imports).first()["text"]
    assert text.startswith("# Repo Map: p\n\n## a.py  (python, 21 lines)\n  import os\n") and "    def size(self, deep: bool = False) -> int  [L15]" in text
    assert "size" not in full_map(files_, symbols, imports, 1).first()["text"]
    focus = focused_map(files_, symbols, imports, spark.createDataFrame([("p", "src/b.go")], "project string, path string")).first()["text"]
    assert "### src/b.go" in focus and "  a.py  (21 lines, 2 symbols)" in focus
    assert '"path":"a.py"' in map_json(files_, symbols, imports).first()["json"]
    assert {r["module"]: r["n_symbols"] for r in module_rollup(files_, symbols).collect()} == {"(root)": 2, "src": 1}


def test_fastapi(spark):
    f = table(spark, [("a.py", PY)])
    r = fw.fastapi_routes(f).first()
    assert (r["method"], r["path"], r["line"], r["function_name"], r["params"]) == ("GET", "/items/{id}", 4, "read", ["id: int", "q: str"])
    m = fw.fastapi_models(f).first()
    assert (m["name"], m["kind"]) == ("Item", "model") and [(x["name"], x["required"]) for x in m["fields"]] == [("name", True), ("tag", False)]


def test_django(spark):
    f = table(spark, [("app/urls.py", 'urlpatterns = [\n  path("", home),\n  path("a/b/", views.ab),\n]\n'), ("app/models.py", "class M(models.Model):\n    a = models.CharField(null=True)\n    _b = models.IntegerField()\n    c = models.IntegerField()\nx = 1\n    d = models.TextField()\n")])
    assert [(r["path"], r["function_name"]) for r in fw.django_routes(f).orderBy("line").collect()] == [("/", "home"), ("/a/b", "views.ab")]
    assert [(x["name"], x["type"], x["required"]) for x in fw.django_models(f).first()["fields"]] == [("a", "CharField", False), ("c", "IntegerField", True)]


def test_express_react_vue(spark):
    f = table(
        spark,
        [
            ("s.ts", "app.get('/x', h)\ninterface A {\n  a: string;\n  b?: {\n    c: number\n  }\n}\nexport type T = {\n  z: number\n}\n"),
            ("pages/index.tsx", 'export function Home({ a }) { return <Route path="/r" element={<Page />} /> }\ninterface HomeProps {\n  a: string;\n  b?: number\n}\nconst Foo = (x) => 1\n'),
            ("src/app/u/[id]/page.tsx", "axios.post('/api/u')\nfetch('/f', { method: 'POST' })\napi.get('nope')\n"),
            ("store.js", "export const useS = create((set) => 1)\ncreateSlice({ name: 'cart' })\ndefineStore('main')\nnew Vuex.Store({})\n"),
            ("pages/user_list.vue", "<script>defineProps<{\n  a: string\n  b?: number;\n}>()</script>"), ("comp/Big.vue", "<script setup>\ndefineProps<{\n  a: string\n}>()\n</script>"),
            ("router.js", "const routes = [{ path: '/v', component: Vee }]\nuseFetch.get('/n')\n"),
        ],
    )
    assert [(r["method"], r["path"]) for r in fw.express_routes(f.where("path = 's.ts'")).collect()] == [("GET", "/x")]
    models = {r["name"]: r for r in fw.express_models(f.where("path = 's.ts'")).collect()}
    assert [x["name"] for x in models["A"]["fields"]] == ["a", "b", "c"] and models["T"]["kind"] == "type"
    assert {(r["path"], r["component_name"]) for r in fw.react_pages(f).collect()} >= {("/r", "Page"), ("/index", ""), ("/u/:id", "")}
    comps = {r["name"]: r["props"] for r in fw.react_components(f).collect()}
    assert comps["Home"] == ["a: string", "b: number (optional)"] and "Foo" in comps
    assert {(r["method"], r["path"]) for r in fw.react_calls(f).collect()} >= {("POST", "/api/u"), ("POST", "/f")}
    assert {(r["name"], r["kind"]) for r in fw.react_stores(f).collect()} == {("useS", "zustand"), ("cart", "redux")}
    assert {(r["name"], r["kind"]) for r in fw.vue_stores(f).collect()} == {("main", "pinia"), ("root", "vuex")}
    assert {r["path"] for r in fw.vue_pages(f).collect()} == {"/v", "/user:list"}
    assert {r["name"]: r["props"] for r in fw.vue_components(f).collect()} == {"Big": ["a: string"]}
    assert ("GET", "/n") in {(r["method"], r["path"]) for r in fw.vue_calls(f).collect()}


def test_run_analysis(spark):
    f = table(
        spark,
        [
            ("requirements.txt", "FastAPI==1"), ("package.json", '{"dependencies": {"react": "18", "axios": "1"}}'), ("api/a.py", PY), ("web/a.tsx", "fetch('/items')\n"), ("docker-compose.yml", "image: Postgres\nimage: redis"), ("Dockerfile", "FROM redis"),
            (".env.example", "# c\nA=1\nB = x=y \nnope\n"), ("build/x.py", PY), ("go.mod", "module x\nrequire (\n  a v1\n)\n"),
        ],
    )
    a = run_analysis(f)
    p = a.projects.first()
    assert (p["language"], p["framework"], p["project_type"]) == ("python", "fastapi, react", "fullstack")
    assert a.tables["routes"].count() == 1 and a.tables["api_calls"].count() == 1
    assert {(r["name"], r["source"]) for r in a.infra.collect()} == {("PostgreSQL", "docker-compose.yml"), ("Redis", "docker-compose.yml")}
    assert {(r["name"], r["default_value"]) for r in a.env_vars.collect()} == {("A", "1"), ("B", "x=y")}
    assert [r["text"] for r in a.warnings.collect()] == ["[react] framework detected but 0 components extracted"]
    assert render_objects(a.tables["routes"], "routes", ["file", "line"]).first()["text"] == "# API Routes\n\n## GET /items/{id}\n  file: api/a.py  L4\n  handler: read\n  params:\n    id: int\n    q: str\n"
    assert render_objects(a.tables["pages"], "pages", ["line"]).count() == 0
    deps = dependencies_text(f).first()["text"]
    assert "## dependencies\n  axios: 1\n  react: 18" in deps and "## go.mod\n  a v1" in deps


def test_registry_and_env(spark):
    assert fw.list_extractors() == ["fastapi", "django", "express", "react", "vue"] and fw.get_extractor("nope") is None
    rows = parse_env(spark.createDataFrame([(1, "A=1\r\n\r\n#x\nB"), (2, None), (3, "")], "k int, content string"), ["k"]).collect()
    assert [(r["k"], r["name"]) for r in rows] == [(1, "A")]
    assert fw.fastapi_routes(spark.createDataFrame([], FILES)).count() == 0
    assert symbols_of(spark.createDataFrame([("p", "a.py", None)], FILES)).count() == 0
    assert F is not None
