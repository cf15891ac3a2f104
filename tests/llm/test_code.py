import random

import pytest

from sourceloom.functions.lexing import bracket_summary, join_brackets, lex
from sourceloom.llm.attributes import declared, parse_attributes
from sourceloom.llm.handwritten import MINED_FILES, content_evidence, copied_code, mined_patterns, not_handwritten, path_evidence
from sourceloom.llm.parsing import broken_symbols, parse_check, parse_rates, verdict
from sourceloom.llm.splitting import MAX_CHARS, MAX_LINES, plan_pieces, split_items, unit_boundaries, unit_lines

GOOD = {
    "python": 'import os\n\n@dec\ndef f(x, *, y=1):\n    """doc {"""\n    return {x: [y]}\n\n\nclass A:\n    pass\n',
    "javascript": "import a from './a.js';\nexport const f = async (x, y = 2) => {\n  const r = /[({]x[^)}]*$/;\n  state.z ??= `t ${x ? '}' : y} {`;\n  return x\n    .map((z) => z + 1);\n};\nclass B extends A {\n  n = 1;\n  get v() { return this.n; }\n}\nlabel: for (const i of [1, 2]) { if (i) continue label; }\n",
    "typescript": "export interface A<T> {\n  a?: string;\n  b: Array<Array<T>>;\n}\ntype U = | 'x' | 'y';\nexport enum E { A = 1, B }\nexport function f(x: number[], y?: Record<string, number>): unknown {\n  const z = x as unknown as number;\n  return z!;\n}\nabstract class C { private readonly d: number = 1; constructor(public e: string) {} }\nconst q = [1] as const;\nlet w: A<A<A<number>>> = tag`x${1}`;\n",
    "go": 'package p\n\nimport (\n\t"fmt"\n)\n\ntype S struct {\n\ta int `json:"a"`\n}\n\nfunc (s *S) M(ctx context.Context, n ...int) (int, error) {\n\tfor _, x := range n {\n\t\ts.a += x\n\t}\n\tswitch v := y.(type) {\n\tcase int:\n\t\t_ = v\n\t}\n\treturn s.a, fmt.Errorf("x: %w", nil)\n}\n',
    "rust": "use a::b;\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> {\n    pub fn m(&mut self, c: char) -> Result<(), E> {\n        if c == '}' { return Err(\"}\".into()); }\n        let v = vec![1, 2];\n        match v.len() { 0 => {}, _ => log::debug!(\"{:?}\", v), }\n        let raw = self.0.1 + c.x.0;\n        Ok(())\n    }\n}\n",
    "java": "package a.b;\n\nimport java.util.List;\n\n// c {\nfinal class A<T> extends B {\n    private int x = 1;\n    static final int[] D = {1, 2};\n    @Override\n    public List<String> m(List<T> a, int b) throws E {\n        for (String s : a) { x += (int) 2L; }\n        String t = \"\"\"\n  }{\n  \"\"\";\n        return a == null ? null : List.of(\"x\");\n    }\n}\n",
}
ENDING = {"python": "py", "javascript": "js", "typescript": "ts", "go": "go", "rust": "rs", "java": "java"}


@pytest.mark.parametrize("language", GOOD)
def test_valid_and_broken(language):
    text = GOOD[language]
    assert verdict(language, text) is None and verdict(language, text.replace("\n", "\r\n")) is None
    mark = "#" if language == "python" else "//"
    assert verdict(language, "") is None and verdict(language, f"{mark} only a comment\n\n") is None
    for bad in (text + "<<<<<<< HEAD\n", text + "}\n", text[: text.rindex("\n", 0, len(text) - 6)].rsplit("{", 1)[0] + "{", "version lfs/pointer v2\noid sha256:abc\nsize 3\n", "This is a text about code.\n", text + "x = “y”\n", text + ("/* open" if language != "python" else '"""open')):
        assert verdict(language, bad) is not None, bad[-60:]
    for other in GOOD:
        if other != language and (other, language) != ("javascript", "typescript"):
            assert verdict(language, GOOD[other]) is not None, other


def test_bracket_summaries_are_associative():
    rng = random.Random(3)
    for _ in range(300):
        pieces = ["".join(rng.choice("(){}[] x") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        a, b, c = (bracket_summary(lex("go", p).tokens) for p in pieces)
        whole = bracket_summary(lex("go", "".join(pieces)).tokens)
        assert join_brackets(join_brackets(a, b), c) == join_brackets(a, join_brackets(b, c))
        assert join_brackets(join_brackets(a, b), c)[2] == whole[2] and (whole[2] or join_brackets(join_brackets(a, b), c) == whole)


def test_ranges_agree_with_whole_files(spark):
    rows = []
    for k, (language, text) in enumerate(GOOD.items()):
        rows += [(k * 10, f"a.{ENDING[language]}", text * (1 if language in ("go", "java") else 3)), (k * 10 + 1, f"b.{ENDING[language]}", text + "}\n"), (k * 10 + 2, f"c.{ENDING[language]}", text[:-9])]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string")
    whole = {r["file_id"]: r["parses"] for r in parse_check(df).collect()}
    cut = {r["file_id"]: r["parses"] for r in parse_check(df, range_chars=90).collect()}
    assert whole == cut and any(whole.values()) and not all(whole.values())


def test_parse_tables(spark):
    rows = [(1, "p", "a.py", "x = 1", "k"), (1, "p", "a.py", "x = 1", "k"), (2, "p", "b.py", "x = (", "k"), (3, "p", "c.txt", "((", "k"), (4, "p", "d.go", None, "k"), (5, "p", "e.js", "", "k"), (6, "p", None, "x", "k")]
    df = spark.createDataFrame(rows, "file_id bigint, project string, path string, content string, language string")
    assert {(r["file_id"], r["parses"]) for r in parse_check(df).collect()} == {(1, True), (2, False), (5, True)}
    assert parse_check(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, "a.py", "PY"), (2, "b.py", None), (2, "b.py", None)], "file_id bigint, path string, language string")
    rates = {(r["project"], r["language"]): (r["n_files"], r["n_broken"]) for r in parse_rates(df, files).collect()}
    assert rates == {("p", "python"): (2, 1), ("p", "javascript"): (1, 0)}
    symbols = spark.createDataFrame([(2, None, 3), (2, 0, 7)], "file_id bigint, parent_ord int, line int")
    r = broken_symbols(df, symbols).collect()
    assert [(x["file_id"], x["n_symbols"], x["n_top_level"], x["last_line"]) for x in r] == [(2, 2, 1, 7)]


def test_units():
    py = "import a\n# c\n@d(\n  1)\ndef f():\n    def g(): pass\n\n# far\n\nclass A:\n    '''\ndef no(): pass\n'''\nx = 1\nasync def h(): pass\n"
    assert [x + 1 for x in unit_lines("a.py", py)] == [2, 10, 15]
    js = "const a = 1;\n/**\n * d\n */\nexport default async function f() {\n  function g() {}\n}\nconst h = (x) => {\n};\nconst k = f(() => 1);\nclass C {\n  m() {}\n}\nconst t = `\nfunction no() {\n`;\n"
    assert [x + 1 for x in unit_lines("a.js", js)] == [2, 8, 11]
    assert [x + 1 for x in unit_lines("a.ts", "let a;\nexport interface I {}\ntype T = number;\n@x\nabstract class C {}\nenum E {}\nconst f = (x: number): string => 'a';\n")] == [2, 3, 4, 6, 7]
    assert [x + 1 for x in unit_lines("a.go", "package p\n\nvar x = 1\n// d\nfunc F() {\n}\n\ntype (\n\tA int\n)\n")] == [4, 8]
    assert [x + 1 for x in unit_lines("a.rs", "use x;\n#[a]\npub(crate) struct S;\nconst C: u8 = 1;\npub const fn f() {}\nimpl S {\n    fn g() {}\n}\n")] == [2, 5, 6]
    assert [x + 1 for x in unit_lines("A.java", "package p;\n\n/** d */\n@A(1)\npublic final class A {\n    class B {}\n}\n@interface N {}\nrecord R(int a) {}\n")] == [3, 8, 9]
    md = "# a\n\ntext\nmore\n===\n\n```\n# no\n```\n- item\n---\n## b ##\n    # code\n#no\n> # q\n\nx\n---\n~~~~\n# no\n~~~\n~~~~\n"
    assert [x + 1 for x in unit_lines("a.md", md)] == [1, 3, 12, 15, 17]
    assert unit_lines("a.json", "{}") == [] and unit_lines(None, "def f(): pass") == []
    # a part of a file that begins inside a class and a comment
    assert [x + 1 for x in unit_lines("a.rs", " */\n    fn inner() {}\n}\n\nfn outer() {}\n", True)] == [5]


def test_pieces_cover_and_fit():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([1, 5, 80, 300, 5000]) for _ in range(rng.randint(1, 200))]
        plan = plan_pieces(lengths, [k for k in range(len(lengths)) if rng.random() < 0.1], {k for k in range(len(lengths)) if rng.random() < 0.1}, 60, 4000, 5, 200)
        assert plan[0][2] == 0 and plan[-1][3] == sum(lengths)
        assert all(b - a + 1 <= 60 and y - x <= 4000 for a, b, x, y in plan) and all(q[2] <= p[3] and q[3] > p[3] for p, q in zip(plan, plan[1:]))


def test_split_tables(spark):
    text = "".join(f"# note\ndef f{k}():\n    return {k}\n\n" for k in range(60))
    md = "".join(f"Head {k}\n----\n\ntext\n\n" for k in range(40))
    rows = [(1, "a.py", text, 1, "p"), (1, "a.py", text, 1, "p"), (2, "b.md", md, None, "q"), (3, "c.py", "x = 1", 1, "p"), (4, "d.py", None, 1, "p"), (5, "e.txt", "y" * 9001, 7, "p"), (6, None, "z\n" * 70, 1, "p")]
    df = spark.createDataFrame(rows, "chunk_id bigint, uri string, content string, start_line int, piece string")
    for chars in (1_000_000, 200):
        found = {}
        for r in unit_boundaries(df, range_chars=chars).collect():
            found.setdefault(r["chunk_id"], []).append(r["line_no"])
        assert sorted(found[1]) == [1 + 4 * k for k in range(1, 60)] and sorted(found[2]) == [1 + 5 * k for k in range(1, 40)] and found[5] == [0] and found[6] == [0] and set(found) == {1, 2, 5, 6}
        pieces = {}
        for r in split_items(df, range_chars=chars).orderBy("chunk_id", "piece_no").collect():
            pieces.setdefault(r["chunk_id"], []).append(r)
        for k, source, first in ((1, text, 1), (2, md, 1), (5, "y" * 9001, 7)):
            whole = ""
            for r in pieces[k]:
                assert len(r["piece"]) <= MAX_CHARS and r["piece"].rstrip("\n").count("\n") + 1 <= MAX_LINES
                assert source[r["start_offset"] : r["start_offset"] + len(r["piece"])] == r["piece"] and r["start_line"] == first + source.count("\n", 0, r["start_offset"])
                whole = whole[: r["start_offset"]] + r["piece"]
            assert whole == source
    assert unit_boundaries(df.limit(0)).count() == 0


def test_attribute_files():
    rules = parse_attributes(".gitattributes", "# c\n*.gen.ts linguist-generated\nlib/** linguist-vendored=true\n/docs linguist-documentation\n") + parse_attributes("lib/own/.gitattributes", "*.js -linguist-vendored\n")
    assert declared("a/b.gen.ts", rules) == {"linguist-generated": True}
    assert declared("lib/x/y.js", rules) == {"linguist-vendored": True} and declared("lib/own/z.js", rules) == {"linguist-vendored": False}
    assert declared("src/a.ts", rules) == {}


def test_content_evidence():
    assert content_evidence("a.py", "# Code generated by x. DO NOT EDIT.\nx = 1\n")[0] == ["generated"]
    assert content_evidence("a.py", "BANNER = 'Code generated by x. DO NOT EDIT.'\n")[0] == [] and content_evidence("a.py", "# keep the order; do not edit the order\n")[0] == []
    assert content_evidence("a.go", "// Copied from lib 1.2.3, kept as is upstream.\npackage p\n")[0] == ["vendored"]
    tight = "!function(e,t){" + "".join(f"function a{k}(x,y){{return x?y+{k}:x.b}}" for k in range(60)) + "}();"
    assert content_evidence("a.js", tight)[0] == ["minified"] and content_evidence("a.js", "const HELP = '" + "long words here " * 60 + "';\nfunction f() {\n  return 1;\n}\n" * 3)[0] == []
    assert content_evidence("a.py", "T = [\n" + "    1, 2, 3, 4, 5, 6,\n" * 30 + "]\n")[0] == ["data"] and content_evidence("a.py", GOOD["python"] * 9 + "T = [1, 2, 3]\n")[0] == []
    assert content_evidence("a.py", None) == ([], None)
    assert path_evidence("a/node_modules/x.js") == ["vendored"] and path_evidence("src/generator/x.ts") == [] and path_evidence("a_pb2.py") == ["generated"] and path_evidence("x.min.js") == ["minified"]


def test_code_from_templates_and_notices_in_other_words():
    py = "import log\n\nLIMIT = 7\n" + "".join(f"\n\ndef get_part_{k:03}(message):\n    return message.fields[{k}]\n" for k in range(1, 14))
    java = "package a;\n\n" + "".join(f"class Part{k:03} {{\n    int get() {{\n        return {k};\n    }}\n}}\n\n" for k in range(1, 12))
    assert content_evidence("a.py", py)[0] == ["generated"] and content_evidence("A.java", java)[0] == ["generated"]
    own = "".join(f"\n\ndef test_case_{k}():\n    assert f({', '.join('xy'[j % 2] for j in range(k))}) == g{'(h' * (k % 5)}{')' * (k % 5)}\n" for k in range(1, 14))
    few = "".join(f"\n\ndef step_{k}(x):\n    return x + {k}\n" for k in range(1, 6))
    assert content_evidence("a.py", own)[0] == [] and content_evidence("a.py", few)[0] == [] and content_evidence("a.py", few + GOOD["python"] * 9)[0] == []
    assert content_evidence("a.go", "// This file was produced by tool from a.idl; changes will be lost.\npackage p\n")[0] == ["generated"]
    assert content_evidence("a.py", "# Machine-generated by x/y. Edit the template instead.\nx = 1\n")[0] == ["generated"]
    assert content_evidence("a.py", "# Written by hand; do not edit the order.\n# The report is written by tool; see the docs.\n# Changes will be lost if you don't save.\nx = 1\n")[0] == []


def test_not_handwritten(spark):
    lib = "".join(f"export function f{k}(a, b) {{\n  return a + b + {k};\n}}\n" for k in range(8))
    rows = [(k, f"p{k}", f"vendor/lib/a{k}.js" if k % 2 else f"src/x/a{k}.js", lib + ("// c\r\n" if k == 2 else "")) for k in range(6)]
    rows += [(10, "p1", "src/own.js", "export const a = 1;\n"), (10, "p1", "src/own.js", "export const a = 1;\n"), (11, "q", ".gitattributes", "gen2/* linguist-generated\nvendor/** -linguist-vendored\n"), (12, "q", "gen2/a.js", "let a = 1;"), (13, "q", "vendor/own.js", "let b = 2;"), (14, "q", None, "x"), (15, "q", "e.js", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "file_id bigint, project string, path string, content string, reasons string")
    found = {r["file_id"]: set(r["reasons"]) for r in not_handwritten(df).collect()}
    assert set(found) == {0, 1, 2, 3, 4, 5, 12} and "copied" in found[2] and found[12] == {"generated"}
    assert not_handwritten(df.limit(0)).count() == 0


def test_windows_of_several_ranges(spark):
    """A part of a file that begins inside a comment or string, or at a depth,
    has the same units in one range as in several."""
    body = "".join(f"def f{k}(x):\n    return {k}\n\n" for k in range(40))
    js = "".join(f"function f{k}(x) {{\n  return {k};\n}}\n\n" for k in range(40))
    rows = [(1, "a.py", "the end of a doc\n\"\"\"\n\n" + body, 50), (2, "b.js", " the end of a note\n */\n" + js, 50), (3, "c.js", "  return 1;\n}\n" + js, 50), (4, "d.js", "}\n" + js, 1), (5, "e.py", body, 50)]
    df = spark.createDataFrame(rows, "chunk_id bigint, uri string, content string, start_line int")
    one, many = ({(r["chunk_id"], r["line_no"]) for r in unit_boundaries(df, range_chars=n).collect()} for n in (1_000_000, 200))
    assert one == many and {k for k, line in one if line} == {1, 2, 3, 4, 5}


def test_order_is_carried_from_range_to_range(spark):
    go = 'package p\n\nimport "fmt";\n\n' + "".join(f"func f{k}() {{\n\tfmt.P({k})\n}}\n\n" for k in range(9))
    java = "package a.b;\n\nimport java.util.List;\nimport java.util.Map;\n\n" + "".join(f"class A{k} {{\n    int x = {k};\n}}\n\n" for k in range(9))
    bad = [("a.go", go + 'import "os";\n\n' + "var x = 1;\n" * 9), ("b.go", GOOD["go"] * 3), ("a.java", java + "import java.util.Set;\n" * 9), ("b.java", java + "package c;\n" + "class Z { }\n" * 9), ("c.java", GOOD["java"] * 3)]
    rows = [(k, *row) for k, row in enumerate([("good.go", go), ("good.java", java), *bad])]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string")
    for chars in (1_000_000, 90):
        assert {r["file_id"] for r in parse_check(df, range_chars=chars).where("parses").collect()} == {0, 1}


def test_python_too_deep_for_the_parser():
    deep = "x = " + "-" * 200_000 + "1\n"
    assert verdict("python", deep) == "nested too deeply for the parser"
    assert verdict("python", "x = " + "a + " * 20_000 + "b\n") is None and verdict("python", "x = " + "a + " * 20_000 + "b\ny = = 1\n") is not None


def test_projects_are_counted_exactly(spark):
    """Code in exactly four projects, patterns in exactly three, of any names."""
    schema = "file_id bigint, project string, path string, shown array<string>, named array<string>, code_hash bigint, copied boolean"
    rows = [(h * 4 + k, f"p{h}-{k}", "a.js", [], [], h, None) for h in range(2000) for k in range(4)]
    assert copied_code(spark.createDataFrame(rows, schema)).count() == 2000
    rows = [(h * 60 + k, f"p{h}-{k % 3}", f"d{h}/a{k}.js", ["generated"], [], None, None) for h in range(600) for k in range(MINED_FILES + 2)]
    assert mined_patterns(spark.createDataFrame(rows, schema)).count() == 600


def test_declared_patterns_are_mined_for_other_projects(spark):
    own = lambda k, j: f"export const a{k}x{j} = {k} + {j};\n"
    rows = [(k * 100 + j, f"p{k}", f"stubs/a{j}.js", own(k, j)) for k in range(7) for j in range(4)] + [(k * 100 + 50, f"p{k}", f"src/a{k}.js", own(k, 50)) for k in range(7)]
    rows += [(k * 100 + 99, f"p{k}", ".gitattributes", "stubs/** linguist-generated\n") for k in range(3)] + [(699, "p6", ".gitattributes", "stubs/a0.js -linguist-generated\n")]
    df = spark.createDataFrame(rows, "file_id bigint, project string, path string, content string")
    found = {r["file_id"]: r["reasons"] for r in not_handwritten(df.where("file_id <> 699")).collect()}
    assert set(found) == {k * 100 + j for k in range(7) for j in range(4)} and found[301] == ["mined"] and "generated" in found[1]
    assert not_handwritten(df.where("path <> '.gitattributes'")).count() == 0
    assert {r["file_id"] // 100 for r in not_handwritten(df).collect()} == {0, 1, 2}
