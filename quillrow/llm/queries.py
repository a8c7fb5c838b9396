"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from quillrow.llm import chat, exact_dedup, language, licenses, lm_score, mixing, near_dedup, packing, quality, sharding

MODULES = (lm_score, chat, language, quality, packing, sharding, licenses, exact_dedup, near_dedup, mixing)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
