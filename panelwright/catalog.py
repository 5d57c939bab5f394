"""Every registered query of the panel operators, with its SQL."""

from __future__ import annotations

from panelwright.plans import decisions, exits, grids, metrics, nulls, pairs, price_checks, profiles, quality, records, requests, stability, states, statistics, streams, studies, zones

MODULES = (metrics, states, quality, zones, statistics, requests, streams, studies, records, nulls, decisions, exits, pairs, grids, price_checks, stability, profiles)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.oracle_sql().items()}
