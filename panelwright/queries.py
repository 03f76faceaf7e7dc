"""Registered queries of the analytics library and the SQL they are compared with."""

from __future__ import annotations

from .plans import forecasts, landed, modelled, panels, portfolios, selections, texts

_MODULES = (panels, forecasts, selections, landed, portfolios, texts, modelled)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
