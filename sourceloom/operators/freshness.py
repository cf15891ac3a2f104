"""Whether written context still mentions what the code has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import is_template

#: Fixed value: directories that needn't be mentioned.
UNMENTIONED_DIRS = ("tests", "test", "docs", "scripts")


def _live(context: DataFrame, name: str) -> DataFrame:
    """(project, doc): a project's context file, if it isn't a template. One
    row per project, which the names meet by an equality."""
    one = context.where(F.col("name") == name).groupBy("project").agg(F.first("content").alias("doc"))
    return one.where(~is_template(F.col("doc")))


def unmentioned_routes(routes: DataFrame, context: DataFrame) -> DataFrame:
    """Routes whose path the contract text lacks: (project, method, path)."""
    return routes.join(_live(context, "api-contracts.md"), "project").where(~F.contains("doc", F.col("path"))).select("project", "method", "path")


def unmentioned_models(models: DataFrame, context: DataFrame) -> DataFrame:
    """Models whose name the model text lacks: (project, name)."""
    return models.join(_live(context, "data-models.md"), "project").where(~F.contains("doc", F.col("name"))).select("project", "name")


def unmentioned_dirs(files: DataFrame, context: DataFrame) -> DataFrame:
    """Top directories that the module text lacks: (project, dir)."""
    dirs = files.where(F.contains("path", F.lit("/"))).select("project", F.substring_index("path", "/", 1).alias("dir")).distinct()
    out = dirs.join(_live(context, "modules.md"), "project").where(~F.contains("doc", F.col("dir")) & ~F.col("dir").isin(*UNMENTIONED_DIRS))
    return out.select("project", "dir")


def freshness_warnings(routes: DataFrame, files: DataFrame, models: DataFrame, context: DataFrame) -> DataFrame:
    """(project, part, text) of everything that isn't mentioned."""
    r = unmentioned_routes(routes, context).select("project", F.lit(0).alias("part"), F.concat(F.lit("Route "), F.col("method"), F.lit(" "), F.col("path"), F.lit(" not mentioned in context/api-contracts.md")).alias("text"))
    d = unmentioned_dirs(files, context).select("project", F.lit(1).alias("part"), F.concat(F.lit("Directory '"), F.col("dir"), F.lit("/' not mentioned in context/modules.md")).alias("text"))
    m = unmentioned_models(models, context).select("project", F.lit(2).alias("part"), F.concat(F.lit("Model '"), F.col("name"), F.lit("' not mentioned in context/data-models.md")).alias("text"))
    return r.unionByName(d).unionByName(m)
