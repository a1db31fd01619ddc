"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from strata.llm import chat_format, decontamination, filter_audit, hamming_search, html_extract, language_id, near_dedup, piece_coding, spelling, substring_dedup, token_files, toxicity, url_filter

_MODULES = (substring_dedup, html_extract, near_dedup, url_filter, token_files, hamming_search, decontamination, chat_format, piece_coding, language_id, filter_audit, toxicity, spelling)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
