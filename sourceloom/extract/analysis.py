"""All framework objects of all projects, from one table of files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.extract.frameworks import REGISTRY, SCHEMAS
from sourceloom.functions.text import lines

log = logging.getLogger(__name__)

#: Extensions and directories of the analysis scan, and its size
#: limit in bytes.
ANALYSIS_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".dart", ".vue", ".svelte")
ANALYSIS_IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", ".sourceloom", ".tox", ".mypy_cache", ".pytest_cache")
ANALYSIS_BYTES = 256_000

#: Marker files of languages, by precedence.
LANGUAGE_MARKERS = [("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("package.json", "javascript"), ("tsconfig.json", "typescript"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java"), ("pubspec.yaml", "dart")]

#: Words of compose files and Dockerfiles, and what they tell.
COMPOSE_NAMES = ["docker-compose.yaml", "docker-compose.yml", "compose.yaml", "compose.yml"]
COMPOSE_WORDS = [("postgres", "PostgreSQL", "database"), ("mysql", "MySQL", "database"), ("mariadb", "MariaDB", "database"), ("mongo", "MongoDB", "database"), ("redis", "Redis", "cache"), ("rabbitmq", "RabbitMQ", "queue"), ("kafka", "Kafka", "queue"), ("elasticsearch", "Elasticsearch", "search"), ("minio", "MinIO", "storage"), ("nginx", "Nginx", "proxy")]
DOCKER_NAMES = ["Dockerfile", "dockerfile"]
DOCKER_WORDS = [("postgres", "PostgreSQL", "database"), ("mysql", "MySQL", "database"), ("redis", "Redis", "cache")]
ENV_NAMES = [".env.example", ".env.sample", ".env.template", ".env.development"]


@dataclass
class Analysis:
    """Tables by project: frameworks (project, framework, ord), projects
    (project, language, framework, project_type), the six object tables, infra,
    env_vars and warnings (project, ord, text)."""

    frameworks: DataFrame
    projects: DataFrame
    tables: dict[str, DataFrame]
    infra: DataFrame
    env_vars: DataFrame
    warnings: DataFrame


def analysis_files(files: DataFrame) -> DataFrame:
    """Files of the analysis scan: by extension, directory and size."""
    keep = F.lit(False)
    for e in ANALYSIS_EXTENSIONS:
        keep = keep | F.col("path").endswith(e)
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return files.where(keep & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ANALYSIS_IGNORED])) & (F.octet_length("content") <= ANALYSIS_BYTES))


def detect_frameworks(files: DataFrame) -> DataFrame:
    """(project, framework, ord): a framework is there if the lower-cased text
    of one of its marker files at the root has its word."""
    rows = [(e.name, path, word, k) for k, e in enumerate(REGISTRY.values()) for path, word in e.markers]
    markers = F.broadcast(files.sparkSession.createDataFrame(rows, "framework string, path string, word string, ord int"))
    hit = files.join(markers, "path").where(F.contains(F.lower("content"), F.lower("word")))
    return hit.select("project", "framework", "ord").distinct()


def _first_of(files: DataFrame, names: list[str]) -> DataFrame:
    """Per project the first existing file of a list of names at the root."""
    rows = F.broadcast(files.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "path string, pref int"))
    found = files.join(rows, "path")
    return found.groupBy("project").agg(F.min_by(F.struct("path", "content"), "pref").alias("f")).select("project", F.col("f.path").alias("source"), F.col("f.content").alias("content"))


def project_kinds(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(project, language, framework, project_type) of every project."""
    spark = files.sparkSession
    kinds = spark.createDataFrame([(e.name, e.language, e.project_type) for e in REGISTRY.values()], "framework string, language string, kind string")
    known = frameworks.join(F.broadcast(kinds), "framework").groupBy("project").agg(
        F.min_by("language", "ord").alias("first_language"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "framework"))), lambda s: s["framework"]), ", ").alias("framework"),
        F.bool_or(F.col("kind") == "frontend").alias("front"), F.bool_or(F.col("kind") == "backend").alias("back"), F.bool_or(F.col("kind") == "mobile").alias("mobile"),
    )
    marks = F.broadcast(spark.createDataFrame([(p, lang, k) for k, (p, lang) in enumerate(LANGUAGE_MARKERS)], "path string, guess string, pref int"))
    guessed = files.select("project", "path").join(marks, "path").groupBy("project").agg(F.min_by("guess", "pref").alias("guess"))
    kind = F.when(F.col("front") & F.col("back"), "fullstack").when(F.col("front"), "frontend").when(F.col("mobile"), "mobile").otherwise("backend")
    every = files.select("project").distinct().join(known, "project", "left").join(guessed, "project", "left")
    return every.select("project", F.coalesce("first_language", "guess", F.lit("unknown")).alias("language"), F.coalesce("framework", F.lit("")).alias("framework"), kind.alias("project_type"))


def infrastructure(files: DataFrame) -> DataFrame:
    """(project, name, kind, source, details): words found in the compose file
    and the Dockerfile, the first source of a name."""
    out = None
    for place, (names, words) in enumerate(((COMPOSE_NAMES, COMPOSE_WORDS), (DOCKER_NAMES, DOCKER_WORDS))):
        known = F.array(*[F.struct(F.lit(place * 100 + k).alias("ord"), F.lit(w).alias("word"), F.lit(n).alias("name"), F.lit(t).alias("kind")) for k, (w, n, t) in enumerate(words)])
        hits = _first_of(files, names).select("project", "source", F.lower("content").alias("text"), F.inline(known)).where(F.contains("text", F.col("word"))).drop("text", "word")
        out = hits if out is None else out.unionByName(hits)
    first = out.groupBy("project", "name").agg(F.min_by(F.struct("ord", "kind", "source"), "ord").alias("f"))
    return first.select("project", "name", "f.kind", "f.source", F.lit(None).cast("string").alias("details"))


def parse_env(files: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """keys, ``ord``, ``name`` and ``default_value`` of each KEY=VALUE line;
    blank lines and comments don't count, the first = divides."""
    split = files.select(*keys, F.posexplode(lines(F.col(text_col))).alias("ord", "raw"))
    line = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    kept = split.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    strip = r"(?U)^\s+|\s+$"
    return kept.select(*keys, "ord", F.regexp_replace(F.regexp_extract("line", "(?s)^([^=]*)=", 1), strip, "").alias("name"), F.regexp_replace(F.regexp_extract("line", "(?s)^[^=]*=(.*)$", 1), strip, "").alias("default_value"))


def environment(files: DataFrame) -> DataFrame:
    """(project, name, source, default_value, description) of the first
    existing example file."""
    found = parse_env(_first_of(files, ENV_NAMES), ["project", "source"])
    return found.select("project", "name", "source", "default_value", F.lit(None).cast("string").alias("description"))


def run_analysis(files: DataFrame) -> Analysis:
    """Runs every registered extractor on the projects that have its framework
    and unites the tables. A table that can't be built becomes a warning."""
    spark = files.sparkSession
    frameworks = detect_frameworks(files)
    sources = analysis_files(files)
    tables: dict[str, DataFrame] = {}
    failed: list[tuple[str, str]] = []
    detected = {r["framework"] for r in frameworks.select("framework").distinct().collect()}  # at most those registered
    for name, schema in SCHEMAS.items():
        out = spark.createDataFrame([], schema)
        for extractor in REGISTRY.values():
            build = extractor.tables.get(name)
            if build is None or extractor.name not in detected:
                continue
            own = sources.join(F.broadcast(frameworks.where(F.col("framework") == extractor.name).select("project")), "project", "left_semi")
            try:
                out = out.unionByName(build(own))
            except Exception as e:
                log.warning("%s of %s: %s", name, extractor.name, e)
                failed.append((extractor.name, f"{extractor.name}: {name} failed: {e}"))
        tables[name] = out
    warnings = frameworks.join(F.broadcast(spark.createDataFrame(failed, "framework string, text string")), "framework").select("project", F.lit(0).alias("ord"), "text")
    wanted = spark.createDataFrame(
        [(e.name, n, k) for e in REGISTRY.values() for k, n in enumerate({"backend": ("routes", "models"), "frontend": ("components",)}.get(e.project_type, ()))],
        "framework string, wanted string, w int",
    )
    have = None
    for n in ("routes", "models", "components"):
        rows = tables[n].select("project", F.lit(n).alias("wanted")).distinct()
        have = rows if have is None else have.unionByName(rows)
    lacking = frameworks.join(F.broadcast(wanted), "framework").join(have, ["project", "wanted"], "left_anti")
    text = F.concat(F.lit("["), F.col("framework"), F.lit("] framework detected but 0 "), F.col("wanted"), F.lit(" extracted"))
    warnings = warnings.unionByName(lacking.select("project", (1 + F.col("ord") * 2 + F.col("w")).alias("ord"), text.alias("text")))
    return Analysis(frameworks, project_kinds(files, frameworks), tables, infrastructure(files), environment(files), warnings)
