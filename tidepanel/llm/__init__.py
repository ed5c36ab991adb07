"""Operators of a training-data pipeline, and their registered queries."""
from __future__ import annotations

import importlib

MODULES = ("sharding", "quality", "secrets", "packing", "ngram_join", "line_dedup", "decontaminate", "warc", "langid", "toxicity", "repair", "mixing", "whitening")


def load() -> tuple[dict, dict]:
    found, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tidepanel.llm.{name}")
        found |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2].isdigit() and callable(f)}
        sql |= getattr(module, "ORACLE", {})
    return found, sql
