import datetime as dt
import random

from sourceloom.operators.references import orphan_references, orphan_report

CALLS = "call_id bigint, project string, method string, path string, scanned_at timestamp_ntz, refs string, extra string"
ROUTES = "project string, method string, path string, first_seen timestamp_ntz, removed_at timestamp_ntz, extra int"


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def found(spark, calls, routes):
    c = spark.createDataFrame([(*x, "r", "e") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 1) for x in routes], ROUTES)
    return {x["call_id"] for x in orphan_references(c, r).collect()}


def test_matching_rules(spark):
    routes = [
        ("p", "get ", "/a/{id}", day(0), day(10)), ("p", "GET", "/a/{id}/", day(20), None), ("p", "all", "/any", day(0), None), ("p", "POST", "/b/<int:x>/c", day(0), None),
        ("q", "GET", "/only-q", day(0), None), ("p", "GET", "/never", None, None), ("p", "PUT", "/", day(0), None),
    ]
    calls = [
        (1, "p", None, "/a/7", day(5)), (2, "p", "GET", "/a/7?x=1#f", day(15)), (3, "p", " get", "a//${item.id}/", day(25)), (4, "p", "DELETE", "/any", day(1)), (5, "p", "POST", "/b/1/c", day(1)),
        (6, "p", "POST", "/b/:x/C", day(1)), (7, "p", "GET", "/only-q", day(1)), (8, "p", "GET", None, day(1)), (9, "p", "GET", "HTTPS://x/a/1", day(1)), (10, "p", "GET", "${base}/a/9", day(1)),
        (11, "p", "GET", "/never", day(1)), (12, None, "GET", "/a/1", day(1)), (13, "p", "GET", "/a/1", None), (14, "p", "PUT", "", day(1)), (15, "p", "POST", "/b/{z}/{c}", day(1)), (16, "p", "GET", "/a/1", day(10)),
    ]
    assert found(spark, calls + calls[:3], routes) == {2, 6, 7, 11, 12, 13, 15, 16}


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [(1, "p", "GET", "/a", day(1))], []) == {1}
    assert found(spark, [], [("p", "GET", "/a", day(0), None)]) == set()


def test_against_brute_force(spark):
    rng = random.Random(4)
    seg = lambda: rng.choice(["a", "b", "{x}", ":y", "[z]"])
    routes = [("p", rng.choice(["GET", "POST", "ALL"]), "/" + "/".join(seg() for _ in range(rng.randint(1, 3))), day(s := rng.randint(0, 20)), rng.choice([None, day(s + rng.randint(0, 9))])) for _ in range(60)]
    calls = [(k, "p", rng.choice(["GET", "POST", None]), "/" + "/".join(seg() for _ in range(rng.randint(1, 3))), day(rng.randint(0, 30))) for k in range(300)]
    hole = lambda s: s[0] in "{:["

    def exists(c):
        parts = [s for s in c[3].split("/") if s]
        parts = parts[1:] if c[3].split("/")[0] and hole(parts[0]) else parts
        for _, m, path, a, b in routes:
            rp = [s for s in path.split("/") if s]
            if m in ("ALL", c[2] or "GET") and a <= c[4] and (b is None or b > c[4]) and len(rp) == len(parts) and all(hole(r) or (not hole(s) and r == s) for r, s in zip(rp, parts)):
                return True
        return False

    assert found(spark, calls, routes) == {c[0] for c in calls if not exists(c)}


def test_hot_keys_and_report(spark):
    routes = [("p", "GET", "/hot", day(0), day(5))]
    calls = [(k, "p", "GET", "/hot", day(k % 40)) for k in range(3000)] + [(5000, "p", "GET", "/cold", day(1))]
    c = spark.createDataFrame([(*x, "r", "e") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 1) for x in routes], ROUTES)
    assert orphan_references(c, r).count() == sum(k % 40 >= 5 for k in range(3000)) + 1
    report = {x["period"].month: x for x in orphan_report(c, r).collect()}
    assert report[1]["n_references"] + report[2]["n_references"] == 3001
    assert report[2]["n_orphans"] == report[2]["n_references"]
