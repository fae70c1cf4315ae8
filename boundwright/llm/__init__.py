"""Operators for preparing language-model training data.

Each module holds one operator with a general interface, the query that applies it to its whole
table, and SQL for that query where SQL can say the same. Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "warc",
    "decontaminate",
    "simhash",
    "sharding",
    "token_counts",
    "attention",
    "url_templates",
    "quality_rules",
    "quality_model",
    "bpe",
    "conversation_repair",
    "prefix_trie",
    "ngram_join",
)


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return found
