"""Queries of the training-data operators and their SQL twins."""

from importlib import import_module
from importlib.util import find_spec

NAMES = [
    "secrets", "mixing", "sharding", "token_counts", "quality", "decontam", "language", "line_dedup", "near_dedup", "warc",
    "private", "phrases", "search",
]


def modules():
    return [import_module(f"freshet.llm.{name}") for name in NAMES if find_spec(f"freshet.llm.{name}")]


def queries():
    return {name: fn for module in modules() for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in modules() for name, text in module.SQL.items()}
