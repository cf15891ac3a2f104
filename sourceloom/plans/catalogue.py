"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from sourceloom.plans import references, retrieval, scans, written

_MODULES = (references, retrieval, scans, written)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return retrieval.hybrid_search(spark, sf_dir)
