"""The registered queries: each key with its Spark query and oracle SQL."""

from __future__ import annotations

import importlib

from cairn.catalog.registry import REGISTRY

MODULES = ("relational", "profiling", "prep", "models", "evaluation", "text",
           "events", "series", "signal", "selection", "runlog")


def load():
    for m in MODULES:
        importlib.import_module(f"cairn.catalog.{m}")
    return REGISTRY
