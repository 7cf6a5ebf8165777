"""Operators for preparing training text: deduplication, decontamination, language, tokens, formatting, extraction, packing."""

from importlib import import_module

#: Modules whose QUERIES and ORACLES are registered.
MODULES = [
    "exact_dedup",
    "chat_format",
    "main_text",
    "token_counts",
    "packing",
    "language",
    "jaccard_join",
    "decontaminate",
    "suffix_dedup",
    "substring_dedup",
    "filter_audit",
    "prefix_trie",
    "sharding",
]


def catalog() -> tuple[dict, dict]:
    """Queries by name, and the SQL of those that SQL can express."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"casequarry.llm.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLES
    return queries, sql
