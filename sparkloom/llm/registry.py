"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from sparkloom.llm import decontamination, html_extraction, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, suffix_dedup, url_filter
from sparkloom.llm.sql import EXTRA

MODULES = [decontamination, html_extraction, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, url_filter, substring_dedup]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()} | EXTRA
