"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("mixing", "exact_topk", "sharding", "token_counts", "quality_rules", "licenses", "token_files", "quality_model", "jaccard_join", "packing", "centroids", "substrings", "turn_repair")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f".{name}", __package__), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
