"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in ("q_simhash", "q_decontaminate", "q_mixing", "q_pii", "q_quality", "q_toxicity", "q_urlfilter", "q_vafile", "q_sharding", "q_tokenstore"):
    _module = importlib.import_module(f"refloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
