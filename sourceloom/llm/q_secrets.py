"""Queries of the credential search."""

from __future__ import annotations

from sourceloom.llm.secrets import credentials, redacted
from sourceloom.session import table


def p2_found(spark, sf_dir):
    env = credentials(table(spark, sf_dir, "env_vars"), "env_vars", "env_id", "default_value", "name")
    ev = credentials(table(spark, sf_dir, "evidence"), "evidence", "evidence_id", "content")
    return env.unionByName(ev).select("src", "row_id", "line_no").distinct()


def p2_redacted(spark, sf_dir):
    env = redacted(table(spark, sf_dir, "env_vars"), "env_vars", "env_id", "default_value", "name")
    return env.unionByName(redacted(table(spark, sf_dir, "evidence"), "evidence", "evidence_id", "content"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLES: dict[str, str] = {}
