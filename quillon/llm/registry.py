"""The queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from quillon.llm import bpe, langid, linededup, mixing, periodic, quality, secretscan, simhash, suffixdedup, toxicity, urlrules, vectorcodes, vectordedup

MODULES = (vectordedup, simhash, bpe, quality, linededup, urlrules, toxicity, secretscan, mixing, langid, suffixdedup, vectorcodes, periodic)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
