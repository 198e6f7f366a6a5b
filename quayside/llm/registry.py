"""Queries of this subpackage, by name: builders over (spark, folder) and the same answers in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["toxicity", "html", "quality", "packing", "mixture_lm", "topk", "jaccard", "mixing", "substrings", "tokens", "warc", "merkle", "spelling"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def load_all() -> dict[str, dict]:
    """Import every operator, which registers its query."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"quayside.llm.{name}")
    return {"queries": QUERIES, "sql": ORACLES}
