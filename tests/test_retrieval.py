import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourceloom.functions import text as tx
from sourceloom.operators.chunking import line_windows
from sourceloom.operators.compress import compress, kept_lines
from sourceloom.operators.index import Index, build_index, query_index, symbol_windows, window_symbols
from sourceloom.operators.rank import bm25_scores, search, search_workspace, top_bm25
from sourceloom.operators.slots import greedy_pack, pack_stats, render_prompt, with_presets


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_lines_follow_splitlines(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029", "a\n\n", "\r\n\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tx.lines(F.col("x")).alias("l")).collect()
    assert all(r["l"] == r["x"].splitlines() for r in rows)


def py_tokens(text):
    out = []
    for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", text):
        out += [p.lower() for p in re.findall(r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+", w) or [w]]
    return out


def test_tokens(spark):
    samples = ["parseHTTPResponse", "MAX_SIZE", "HTTP2", "___", "snake_case2Go", "É_1x", "a1b2 C3"]
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select("x", tx.tokens(F.col("x")).alias("t")).collect()
    assert all(r["t"] == py_tokens(r["x"]) for r in rows)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aB_1 \n", max_size=40), min_size=1, max_size=5))
def test_tokens_property(spark, samples):
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select("x", tx.tokens(F.col("x")).alias("t")).collect()
    assert all(r["t"] == py_tokens(r["x"]) and tx.query_tokens(r["x"]) == r["t"] for r in rows)


def test_paths(spark):
    paths = ["latest.md", "a/readme.rst", "cfg/x.yaml", "src/a.py", "src/core/b.go", "z.py", "a/c/d.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in rows.select(tx.source_type(F.col("path"))).collect()] == ["test", "doc", "config", "code", "code", "code", "code"]
    kept = rows.where(tx.path_filter(F.col("path"), ["src/", "*.md"], ["src/core"])).collect()
    assert [r[0] for r in kept] == ["latest.md", "src/a.py"]
    assert [r[0] for r in rows.orderBy(tx.walk_key(F.col("path"))).collect()][:2] == ["latest.md", "z.py"]
    assert re.match(tx.glob_regex("a*[!b]?.py"), "a/x/cd.py") and not re.match(tx.glob_regex("a?"), "abc")


def test_templates(spark):
    assert one(spark, tx.is_template, "# T\n\n<!-- fill -->\n") and not one(spark, tx.is_template, "# T\ntext")
    assert one(spark, tx.is_unfilled, "a\n<!-- x") and not one(spark, tx.is_unfilled, "<!-- x -->\nb")


def test_windows(spark):
    for n in (0, 1, 39, 40, 41, 70, 71, 100):
        rows = line_windows(spark.createDataFrame([("p", "a.py", "\n".join(map(str, range(n))))], "project string, path string, content string")).orderBy("window_no").collect()
        want = 0 if n == 0 else 1 + math.ceil(max(0, n - 40) / 30)
        assert len(rows) == want
        if rows:
            assert rows[0]["start_line"] == 1 and rows[-1]["end_line"] == n
    assert line_windows(spark.createDataFrame([("p", "a", None)], "project string, path string, content string")).count() == 0


DOCS = [("p", 1, "alpha beta beta"), ("p", 2, "beta gamma"), ("p", 3, "delta"), ("q", 1, "alpha alpha"), ("q", 2, ""), ("q", 3, None)]


def py_bm25(docs, query):
    toks = {k: py_tokens(t or "") for _, k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for q in py_tokens(query):
        df = sum(q in t for t in toks.values())
        if df:
            idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
            for k, t in toks.items():
                tf = t.count(q)
                out[k] = out.get(k, 0) + idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len(t) / avg))
    return {k: v for k, v in out.items() if v > 0}


def test_bm25_and_index(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "project string, doc_key int, content string")
    full = build_index(df)
    full.save(str(tmp_path / "i"))
    for query in ("alpha beta", "beta beta gamma", "", "nothing"):
        for index in (full, query_index(df, query), Index.load(spark, str(tmp_path / "i"))):
            got = {(r["project"], r["doc_key"]): r["bm25"] for r in bm25_scores(index, query).collect()}
            want = {(p, k): v for p in "pq" for k, v in py_bm25([d for d in DOCS if d[0] == p], query).items()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert [r["doc_key"] for r in top_bm25(full, "beta", 1).collect()] == [1]


def test_search_fusion(spark):
    df = spark.createDataFrame([("p", k, f"file{k}.py", 1, 10, c) for k, c in ((1, "alpha word"), (2, "beta word"), (3, "other"))], "project string, doc_key int, path string, start_line int, end_line int, content string")
    symbols = spark.createDataFrame([("p", "file3.py", 0, None, "Alpha", 4), ("p", "file3.py", 1, 0, "beta", 5), ("p", "file1.py", 0, None, "far", 99)], "project string, path string, ord int, parent_ord int, name string, line int")
    hits = symbol_windows(df, symbols)
    assert {(r["doc_key"], r["name_lower"]) for r in hits.collect()} == {(3, "alpha"), (3, "beta")}
    assert {r["doc_key"]: r["symbols"] for r in window_symbols(df, symbols).collect()} == {3: ["Alpha", "Alpha.beta"]}
    rows = search(query_index(df, "alpha"), hits, "alpha", 5).orderBy("final_rank").collect()
    assert [(r["doc_key"], round(r["score"], 6)) for r in rows] == [(1, 0.6), (3, 0.4)]
    assert search_workspace(query_index(df, "alpha"), hits, "alpha", 1).collect()[0]["doc_key"] == 1
    assert search(query_index(df, ""), hits, "", 5).count() == 0


def py_compress(text, query):
    from sourceloom.operators.compress import DROP_LINES, KEEP_LINES

    ls, q = text.splitlines(), set(re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", query.lower()))
    if len(ls) <= 5:
        return text
    scores = []
    for line in ls:
        s = 0.3 if any(re.search(p, line) for p in KEEP_LINES) else 0.0
        shared = set(re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", line.lower())) & q
        s += 0.4 * (len(shared) / max(len(q), 1)) if shared else 0.0
        s -= 0.2 if any(re.search(p, line) for p in DROP_LINES) else 0.0
        scores.append(max(0.0, min(1.0, s)))
    keep = {j for i, s in enumerate(scores) if s >= 0.1 for j in range(max(0, i - 1), min(len(ls), i + 2))}
    for i in sorted(keep, key=lambda i: (scores[i], i))[: max(0, len(keep) - max(3, int(len(ls) * 0.5)))]:
        keep.discard(i)
    out, run = [], 0
    for i, line in enumerate(ls):
        if i in keep:
            out += [f"    [...{run} lines omitted...]"] if run else []
            out.append(line)
            run = 0
        else:
            run += 1
    return "\n".join(out + ([f"    [...{run} lines omitted...]"] if run else []))


LINE = st.sampled_from(["def f(x):", "    x = 1", "# todo later", "", "    return x", "import os", "  print(x)", "value = alpha", "pass", "// note", "@dec"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(LINE, max_size=25), min_size=1, max_size=4))
def test_compression(spark, files):
    texts = ["\n".join(f) for f in files]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string")
    got = {r["k"]: r["compressed"] for r in compress(df, "alpha value", ["k"]).collect()}
    for k, t in enumerate(texts):
        if t.splitlines():
            assert got[k] == py_compress(t, "alpha value")
        else:
            assert k not in got


def test_todo_line_is_not_kept(spark):
    df = spark.createDataFrame([(1, "# todo\n" + "\n".join("x" for _ in range(9)))], "k int, content string")
    assert not any(r["keep"] for r in kept_lines(df, "zzz", ["k"]).collect())


def slots(spark, rows):
    return spark.createDataFrame([("p", n, c, pr, 0.0, k) for k, (n, c, pr) in enumerate(rows)], "prompt_id string, name string, content string, priority int, budget_pct double, insert_ord int")


def fates(spark, sizes, budget):
    df = slots(spark, [(f"s{k}", "w " * n, 50) for k, n in enumerate(sizes)])
    return [r["fate"] for r in greedy_pack(df, budget).orderBy("insert_ord").collect()]


def test_greedy_packing(spark):
    assert fates(spark, [60, 30, 50, 10], 100) == ["whole", "whole", "dropped", "whole"]
    assert fates(spark, [50, 100], 100) == ["whole", "dropped"]
    assert fates(spark, [49, 100], 100) == ["whole", "cut"]
    assert fates(spark, [60, 40], 100) == ["whole", "whole"]
    assert fates(spark, [101], 100) == ["cut"]
    df = slots(spark, [("low", "a " * 80, 10), ("high", "b " * 80, 100), ("none", "", 50)])
    rows = {r["name"]: r["fate"] for r in greedy_pack(df, 100).collect()}
    assert rows == {"high": "whole", "low": "dropped"}


def test_presets_render_and_stats(spark):
    df = spark.createDataFrame([("p", "zeta", "z", None, 0), ("p", "task", "do it", None, 1), ("p", "system", "be", 10, 2), ("p", "task", "do that", None, 3)], "prompt_id string, name string, content string, priority int, insert_ord int")
    full = with_presets(df)
    assert full.where("name = 'task'").first()["priority"] == 80 and full.where("name = 'system'").first()["priority"] == 10 and full.where("name = 'zeta'").first()["priority"] == 50
    assert full.count() == 11
    prompt = render_prompt(greedy_pack(full, 1000)).first()["prompt"]
    assert prompt == "<system>\nbe\n</system>\n\n<task>\ndo that\n</task>\n\n<zeta>\nz\n</zeta>"
    stats = pack_stats(full, 2).first()
    assert stats["total_before_trim"] == 4 and stats["over_budget"] == 2 and stats["slots"]["task"]["priority"] == "HIGH"
