"""Check results: running checks on the driver, and queries on their table."""

from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKS = "kind string, command string, passed boolean, duration_s double, stdout string, stderr string, summary string"

#: Marker files and the check that each calls for, the first
#: marker that exists deciding.
TEST_MARKERS = [("pyproject.toml", [sys.executable, "-m", "pytest", "--tb=short", "-q"]), ("setup.py", [sys.executable, "-m", "pytest", "--tb=short", "-q"]), ("package.json", ["npm", "test"]), ("go.mod", ["go", "test", "./..."]), ("Cargo.toml", ["cargo", "test"])]
LINT_MARKERS = [("pyproject.toml", [sys.executable, "-m", "ruff", "check", "."]), ("package.json", ["npx", "eslint", "."]), ("Cargo.toml", ["cargo", "clippy"])]

#: Characters of output that are kept, from its end.
OUTPUT_CHARS = 5000


def resolve_checks(root: str) -> list[tuple[str, list[str]]]:
    """(kind, command) of the checks that a folder calls for."""
    found = []
    for kind, markers in (("test", TEST_MARKERS), ("lint", LINT_MARKERS)):
        command = next((c for name, c in markers if (Path(root) / name).exists()), None)
        if command:
            found.append((kind, command))
    return found


def check_summary(kind: str, passed: bool, stdout: str, stderr: str) -> str:
    """One line on what a check said."""
    if passed:
        return "Passed"
    said = (stderr or stdout).strip().splitlines()
    if kind == "test":
        telling = [x for x in said if "failed" in x.lower() or "error" in x.lower()]
        if telling:
            return telling[-1].strip()
    if kind == "lint":
        telling = [x for x in said if "error" in x.lower() or "warning" in x.lower()]
        if telling:
            return f"{len(telling)} issue(s) found. First: {telling[0].strip()}"
    return next((x.strip()[:200] for x in reversed(said) if x.strip()), "Failed (no output)")


def run_check(root: str, kind: str, command: list[str], timeout: int = 120) -> tuple:
    """Runs one command in a folder on the driver; a row of CHECKS."""
    shown, began = " ".join(command), time.monotonic()
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        return (kind, shown, False, round(time.monotonic() - began, 2), "", "", f"Timed out after {timeout}s")
    except FileNotFoundError:
        return (kind, shown, False, 0.0, "", "", f"Command not found: {command[0]}")
    passed = done.returncode == 0
    return (kind, shown, passed, round(time.monotonic() - began, 2), done.stdout[-OUTPUT_CHARS:], done.stderr[-OUTPUT_CHARS:], check_summary(kind, passed, done.stdout, done.stderr))


def context_row(warnings: list[str], duration: float = 0.0) -> tuple:
    """The freshness warnings as a row of CHECKS."""
    text = "Passed" if not warnings else f"{len(warnings)} stale context issue(s). First: {warnings[0]}"
    return ("context", "context freshness", not warnings, round(duration, 2), "\n".join(warnings), "", text)


def run_checks(spark: SparkSession, root: str, kinds: set[str] | None = None, checks: list[tuple[str, list[str]]] | None = None, timeout: int = 120) -> DataFrame:
    """Runs the checks of a folder, or those given, as a table. Commands run on
    the driver only, and only when asked for."""
    wanted = [(k, c) for k, c in (checks if checks is not None else resolve_checks(root)) if kinds is None or k in kinds]
    return spark.createDataFrame([run_check(root, k, c, timeout) for k, c in wanted], CHECKS)


def roll_up(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``passed`` (true without checks), ``n_checks`` and ``n_failed``."""
    out = [F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("n_checks"), F.count(F.when(~F.col("passed"), 1)).alias("n_failed")]
    return checks.groupBy(*by).agg(*out) if by else checks.agg(*out)


def feedback(rows: list, max_chars: int = 3000) -> str:
    """The failures among checks (rows with kind, command, passed, summary,
    stdout, stderr) as text of about so many characters."""
    failed = [r for r in rows if not r["passed"]]
    if not failed:
        return "All checks passed: " + ", ".join(r["command"] for r in rows)
    out, left = ["## Verification Failures", ""], max_chars
    for r in failed:
        head = f"### [{r['kind']}] `{r['command']}` — FAILED"
        left -= len(head) + 2
        detail = r["summary"] or r["stderr"] or r["stdout"] or ""
        if len(detail) > left:
            detail = detail[: max(left, 0)] + "\n... [truncated]"
        out += [head, detail, ""]
        left -= len(detail) + 2
        if left <= 0:
            out.append("... [more failures omitted]")
            break
    return "\n".join(out)
