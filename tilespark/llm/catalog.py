"""All queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tilespark.llm import bpe, chat, language, mixing, multi_index, neardup, pii, quality, ranked, repair, repeats, simhash, warc

MODULES = (multi_index, warc, simhash, neardup, repeats, quality, bpe, mixing, chat, language, pii, ranked, repair)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def more() -> dict:
    """Queries beside the numbered operators."""
    return dict(simhash.MORE)
