"""Registered queries over the star-schema and event tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans import corpus, decisions, episodes, evidence, intervals, loops, resampling, rules, text, timeline

MODULES = [intervals, evidence, timeline, rules, episodes, decisions, text, loops, resampling, corpus]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
