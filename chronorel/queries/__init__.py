"""Registered queries of the relational part and their SQL."""

from __future__ import annotations

from . import extras, graph, planning, profiling, similar, temporal

MODULES = (temporal, profiling, graph, planning, similar, extras)
QUERIES = {k: q for m in MODULES for k, q in m.R.queries.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.R.sql.items()}
