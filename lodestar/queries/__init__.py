"""Registered queries of the engine's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lodestar.queries import aggregates, filters, joins, scalars, shapes, statements, windows, writes

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (filters, joins, aggregates, windows, shapes, scalars, writes, statements):
    QUERIES |= _module.registry.queries
    ORACLES |= _module.registry.oracles
