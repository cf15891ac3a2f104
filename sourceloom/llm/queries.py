"""All queries of the subpackage."""

from __future__ import annotations

from sourceloom.llm import q_distinctive, q_handwritten, q_packing, q_parsing, q_quality, q_secrets, q_splitting, q_tokens

_MODULES = (q_distinctive, q_handwritten, q_packing, q_parsing, q_quality, q_secrets, q_splitting, q_tokens)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
