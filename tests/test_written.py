"""Objects written down as specifications and sources are found again."""

import os

import duckdb
import pytest

from sourceloom.plans import written


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    routes = [("p", "get ", f"/a/{{id:int}}/{k}", f"src/r{k % 3}.py", 40 * k, f"f_{k}" if k % 2 else None, ["id: int"] if k % 4 else None) for k in range(40)]
    routes += [routes[3], ("q", "ALL", "/", "r.py", 1, None, []), ("q", "POST", "/b", "r.py", 1, "g", [])]
    calls = [(k, "p", ["GET", None, "post", " put"][k % 4], f"/a/{{x}}/{k % 50}", f"c{k % 5}.ts", 90 * k, f"n{k % 7}" if k % 3 else None) for k in range(60)]
    calls += [calls[5], (90, "q", "POST", "/b", "d.ts", 5, None), (91, "q", "HEAD", "/b", "e.ts", 5, "h"), (92, "q", "GET", None, "e.ts", 5, "h"), (93, "q", "GET", "http://x/b", "f.ts", 5, None)]
    symbols = [("p", f"a/b_{k % 4}.ts", k, None if k % 3 else k - 1, f"Name{k}", ["class", "function", "method"][k % 3], 30 * k, None if k % 2 else "s") for k in range(1, 80)]
    symbols += [symbols[4], ("q", "x.go", 1, None, "_one", "class", 1, None), ("q", "x.go", 2, 1, "_hidden", "method", 2, None), ("q", "x.go", 3, 1, "shown", "method", 3, "s")]
    files = [("p", f"src/x_{k}/y.z/a_b.js") for k in range(4)] + [("q", "top.py"), ("q", "top.py")]
    for name, rows, schema in (
        ("routes", routes, "project string, method string, path string, file string, line int, function_name string, params array<string>"),
        ("api_calls", calls, "call_id bigint, project string, method string, path string, file string, line int, function_name string"),
        ("symbols", symbols, "project string, path string, ord int, parent_ord int, name string, kind string, line int, signature string"),
        ("files", files, "project string, path string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, f"{name}.parquet"))
    return folder


@pytest.mark.parametrize("name", [n for n in written.QUERIES if n in written.ORACLES])
def test_round_trip(spark, tables, name):
    con = duckdb.connect()
    for t in ("routes", "api_calls", "symbols", "files"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    result = con.execute(written.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(map(str, r)) for r in result.fetchall()), key=str)
    got = written.QUERIES[name](spark, tables)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(str(r[c]) for c in columns) for r in got.collect()), key=str) == want and want


def test_skeletons_of_written_specifications(spark, tables):
    rows = written.spec_skeletons(spark, tables).collect()
    assert rows and all(r["code"] and r["filename"].startswith("test_") for r in rows)
    assert any("# API: POST /b" in r["code"] for r in rows)


def test_empty_tables(spark, tables, tmp_path):
    for t in ("routes", "api_calls", "symbols", "files"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("spec_issues", "django_models", "vue_calls", "react_page_files", "vue_components"):
        assert written.QUERIES[name](spark, str(tmp_path)).count() == 0
