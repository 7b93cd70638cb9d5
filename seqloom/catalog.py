"""Registered queries of the sequence and interval operators, with their SQL."""

from __future__ import annotations

from .plans import (
    acoustic_queries, assess_queries, format_queries, interval_queries, long_queries, mark_queries, recording_queries, report_queries, sequence_queries,
    spelling_queries, storage_queries, text_queries,
)

MODULES = (sequence_queries, interval_queries, long_queries, text_queries, mark_queries, acoustic_queries, report_queries, recording_queries, assess_queries, format_queries, storage_queries, spelling_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
