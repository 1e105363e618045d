"""The registered queries of this subpackage, each with the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}
MODULES = ("op1_simhash", "op2_suffix", "op3_warc", "op4_language", "op5_packing", "op6_topk", "op7_chunks", "op8_html", "op9_toxicity", "op10_benchmark",
           "op11_codes", "op12_negatives", "op13_quality")


def query(key: str, sql: str | None = None):
    def deco(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return deco


def load():
    """All queries and their SQL."""
    for m in MODULES:
        importlib.import_module(f"cairn.llm.{m}")
    return QUERIES, SQL
