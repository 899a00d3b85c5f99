"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import causal, fits, models, panel, risk

MODULES = (panel, risk, causal, models, fits)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
