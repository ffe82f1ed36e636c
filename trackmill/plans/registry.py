"""Queries over the test tables, with the SQL that each must agree with."""

from __future__ import annotations

from trackmill.plans import analytics, catalogue, datasets, detections, events, identity, joins, review, trajectory

MODULES = (trajectory, joins, analytics, identity, events, detections, catalogue, review, datasets)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
