"""Source trees as a Spark data source.

Spark's own file sources skip names that begin with a dot or an underscore,
which source trees are full of. This one walks a tree when the query is
planned, deals the files into partitions of similar size, and reads them on the
executors, which must see the same path. Undecodable bytes are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sourceloom.functions.text import glob_regex

SCHEMA = "project string, path string, content string, n_bytes bigint"

#: Directories that scans skip, and the extensions of the symbol
#: scan and of the search index.
SCAN_IGNORED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", ".next", ".nuxt", "vendor")
SYMBOL_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java")
INDEX_EXTENSIONS = (*SYMBOL_EXTENSIONS, ".md", ".rst", ".txt", ".toml", ".yaml", ".yml", ".json", ".cfg", ".ini", ".sh", ".bash")


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str, str]]


def _pattern(path: str, patterns: list[str]) -> bool:
    import re

    return any(re.match(glob_regex(p), path) if "*" in p else path.startswith(p) for p in patterns)


def walk(root: str, ignored: tuple[str, ...] = SCAN_IGNORED, extensions: tuple[str, ...] = (), include: list[str] | None = None, exclude: list[str] | None = None) -> Iterator[tuple[str, str, int]]:
    """(relative path, full path, bytes) of a tree's files, names in order,
    files before subdirectories."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in ignored)
        for name in sorted(names):
            if extensions and not name.endswith(extensions):
                continue
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            if include and not _pattern(path, include) or exclude and _pattern(path, exclude):
                continue
            try:
                yield path, full, os.stat(full).st_size
            except OSError:
                continue


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = {k.lower(): v for k, v in self.options.items()}

        def words(key: str) -> list[str]:
            return [x for x in (o.get(key) or "").split(",") if x]

        found = []
        for root in words("path"):
            root = os.path.abspath(root)
            project = os.path.basename(root)
            for path, full, size in walk(root, tuple(words("ignored")) or SCAN_IGNORED, tuple(words("extensions")), words("include"), words("exclude")):
                if not o.get("maxbytes") or size <= int(o["maxbytes"]):
                    found.append((size, project, path, full))
        n = max(1, min(int(o.get("partitions") or 8), len(found)))
        parts: list[list] = [[] for _ in range(n)]
        loads = [0] * n
        for size, project, path, full in sorted(found, reverse=True):
            k = loads.index(min(loads))
            parts[k].append((project, path, full))
            loads[k] += size + 4096
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for project, path, full in partition.files:
            try:
                with open(full, "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            yield project, path, raw.decode("utf-8", "replace"), len(raw)


class RepoSource(DataSource):
    """Format ``source_tree``: option path has one or more roots, by commas;
    extensions, include, exclude, ignored (by commas), maxBytes, partitions."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, roots: str | list[str], extensions: tuple[str, ...] = (), include: list[str] | None = None, exclude: list[str] | None = None, ignored: tuple[str, ...] = SCAN_IGNORED, max_bytes: int | None = None) -> DataFrame:
    """Files of one or more trees: (project, path, content, n_bytes); a
    project's name is that of its root folder."""
    spark.dataSource.register(RepoSource)
    reader = spark.read.format("source_tree").option("partitions", spark.sparkContext.defaultParallelism)
    for key, values in (("path", [roots] if isinstance(roots, str) else roots), ("extensions", extensions), ("include", include), ("exclude", exclude), ("ignored", ignored)):
        reader = reader.option(key, ",".join(values or []))
    if max_bytes is not None:
        reader = reader.option("maxBytes", str(max_bytes))
    return reader.load()


def find_projects(root: str, folder: str = ".sourceloom") -> list[str]:
    """Roots of a workspace: the path lines of its workspace file that exist,
    else subfolders with a .git, else the root itself."""
    root = os.path.abspath(root)
    listed = os.path.join(root, folder, "workspace.yaml")
    found = []
    if os.path.exists(listed):
        with open(listed, encoding="utf-8", errors="replace") as f:
            for line in f:
                key, _, value = line.strip().partition(":")
                if key == "path" and os.path.exists(os.path.join(root, value.strip())):
                    found.append(os.path.abspath(os.path.join(root, value.strip())))
    else:
        found = [os.path.join(root, n) for n in sorted(os.listdir(root)) if os.path.isdir(os.path.join(root, n, ".git"))]
    return found or [root]
